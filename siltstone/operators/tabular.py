"""Tables as documents: header and mode detection, keys, roles, row texts, metadata and profiles."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V

SAMPLE_ROWS = 20
LONGEST_VALUE = 2000
#: Names of metadata that the engine writes itself (fixed values).
RESERVED = {"source_id", "source_file", "file_id", "chunk_index", "chunk_count", "chunk_level", "parent_chunk_id", "content_hash", "file_ext", "file_mtime", "file_size", "file_name", "relative_path", "sheet_name", "row_number", "row_key", "table_mode", "heading_path"}


#: What the kinds of cells that readers tell are for a table.
KINDS = {"str": "text", "bool": "boolean", "int": "number", "float": "number", "datetime": "date", "date": "date"}


def sheet_modes(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """(path, sheet, mode, header, reason) of sheets by their cells (path, sheet, row_number, col, kind, value).

    The first row with anything in it is the header, the ``SAMPLE_ROWS`` after
    it are judged, and columns that are empty in all of these are no part of the
    table. ``mode`` is skip, document or data_table; a sheet of which this is not
    sure is a document, which loses nothing. ``header`` is the row's number or
    null. ``sheets`` (path, sheet, hidden) also names sheets without cells.
    """
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("kind")]
    filled = cells.where(F.col("row_number").isNotNull() & kind.isNotNull() & (F.trim("value") != "")).select("path", "sheet", "row_number", "col", kind.alias("kind"))
    nth = F.dense_rank().over(W.partitionBy("path", "sheet").orderBy("row_number"))
    sample = filled.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_ROWS + 1)
    columns = sample.groupBy("path", "sheet", "col").agg(
        F.max(F.when(F.col("nth") == 1, F.col("kind"))).alias("title"), F.count_distinct(F.when(F.col("nth") > 1, F.col("kind"))).alias("kinds"),
        F.max("nth").alias("last"), F.min("row_number").alias("first_row"))
    facts = columns.groupBy("path", "sheet").agg(
        F.count("*").alias("used"), F.count_if(F.col("title") == "text").alias("named"), F.count_if(F.col("title") != "text").alias("typed"),
        F.count_if(F.col("kinds") > 0).alias("judged"), F.count_if(F.col("kinds") == 1).alias("even"), (F.max("last") - 1).alias("below"), F.min("first_row").alias("row"))
    if sheets is None:
        facts = facts.withColumn("hidden", F.lit(False))
    else:
        facts = sheets.select("path", "sheet", F.coalesce("hidden", F.lit(False)).alias("hidden")).join(facts, ["path", "sheet"], "left")
    headed = (F.col("typed") == 0) & (F.col("named") >= 0.75 * F.col("used"))
    table = headed & (F.col("used") > 1) & (F.col("below") > 0) & (F.col("even") >= 0.75 * F.col("judged"))
    idle = F.col("hidden") | F.col("used").isNull()
    why = F.when(F.col("hidden"), "hidden").when(F.col("used").isNull(), "empty").when(F.col("used") == 1, "one column").when(~headed, "no header row")
    why = why.when(F.col("below") == 0, "no rows").when(~table, "mixed columns").otherwise("rows of one kind")
    return facts.select(
        "path", "sheet", F.when(idle, "skip").when(table, "data_table").otherwise("document").alias("mode"),
        F.when(~idle & headed & (F.col("used") > 1), F.col("row")).alias("header"), why.alias("reason"))


def titles(row: list) -> list[str]:
    """Header titles, white space collapsed, blanks lettered, repeats numbered."""
    out: list[str] = []
    for i, c in enumerate(row):
        name = " ".join(str(c).split()) if c is not None else ""
        name, n = name or V.column_letters(i), 1
        base = name
        while name in out:
            n += 1
            name = f"{base} ({n})"
        out.append(name)
    return out


def keys(names: list[str]) -> list[str]:
    """Metadata keys of titles, legal, unreserved and unique."""
    out: list[str] = []
    for n in names:
        out.append(V.identifier(n, set(out), RESERVED))
    return out


#: Words in titles of columns that hold text, and titles of columns that hold keys (fixed values).
TEXT_WORDS = ["название", "наименование", "описание", "текст", "комментарий", "примечание", "name", "title", "description", "text", "comment", "summary", "body"]
KEY_TITLES = ["id", "код", "артикул", "sku", "uuid", "ключ", "key", "email", "номер"]


def suggested_roles(names: list[str]) -> tuple[dict[str, str], str | None]:
    """(text or metadata of each column, the key column or None) by their titles; the first column is text if no other is."""
    roles = {n: "text" if any(w in n.lower() for w in TEXT_WORDS) else "metadata" for n in names}
    if names and "text" not in roles.values():
        roles[names[0]] = "text"
    is_key = re.compile("|".join(f"{w}|{w} .*|.* {w}" for w in KEY_TITLES))
    return roles, next((n for n in names if is_key.fullmatch(n.lower())), None)


@dataclass
class Mapping:
    titles: dict[str, str]  # title by column, in order
    text: list[str]  # columns that make up the row's text
    metadata: dict[str, str] = field(default_factory=dict)  # key by column
    key: str | None = None
    template: str | None = None


def unknown_placeholders(m: Mapping) -> list[str]:
    known = set(m.titles.values()) | set(m.titles)
    return [p for p in dict.fromkeys(re.findall(r"\{([^{}]+)\}", m.template or "")) if p not in known]


def shown(c: Column) -> Column:
    """A cell as read: whole numbers without a fraction."""
    whole = c.try_cast("double")
    return F.when((F.typeof(c).isin("double", "float")) & (whole == F.floor(whole)) & (F.abs(whole) < 1e15), F.floor(whole).cast("string")).otherwise(c.cast("string"))


def row_text(m: Mapping) -> Column:
    """``Title: value`` lines, or the filled template; a line with the key leads unless its value is mentioned as a word."""
    if m.template:
        body = F.lit(m.template)
        for c, t in sorted(m.titles.items(), key=lambda x: -len(x[1])):  # longest first
            body = F.replace(body, F.lit("{" + t + "}"), F.coalesce(shown(F.col(c)), F.lit("")))
    else:
        body = F.concat_ws("\n", *[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{m.titles[c]}: "), F.trim(shown(F.col(c))))) for c in m.text])
    body = F.trim(body)
    if not m.key:
        return body
    k = F.trim(shown(F.col(m.key)))
    padded = F.concat(F.lit(" "), F.regexp_replace(body, r"[^\p{L}\p{N}_-]+", " "), F.lit(" "))
    mentioned = F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(k, r"[^\p{L}\p{N}_-]+", " "), F.lit(" ")))
    lead = F.concat(F.lit(f"{m.titles[m.key]}: "), k)
    return F.when((body == "") | k.isNull() | (k == "") | mentioned, body).otherwise(F.concat(lead, F.lit("\n"), body))


def metadata_value(c: Column) -> Column:
    """A cell as metadata text: empty ones absent, long ones cut."""
    t = F.trim(shown(c))
    return F.when(t != "", F.when(F.length(t) > LONGEST_VALUE, F.substring(t, 1, LONGEST_VALUE)).otherwise(t))


def metadata_of(m: Mapping) -> Column:
    """map of key to value of the row's metadata, and ``<key>_truncated`` for cut values."""
    entries = [F.struct(F.lit(k).alias("key"), metadata_value(F.col(c)).alias("value")) for c, k in m.metadata.items()]
    entries += [F.struct(F.lit(f"{k}_truncated").alias("key"), F.when(F.length(F.trim(F.col(c).cast("string"))) > LONGEST_VALUE, "true").alias("value")) for c, k in m.metadata.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def metadata_hash(metadata: Column) -> Column:
    """Digest of the entries in order of their keys."""
    pairs = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.array_join(pairs, "\x01"), 256)


def row_documents(rows: DataFrame, m: Mapping, source: str, sheet: str, number: str = "row_number") -> DataFrame:
    """(id, row_number, row_key, document, metadata, text_hash, metadata_hash) of every row with a text.

    The id is a digest of source, sheet and the key, or without a key the content.
    """
    key = F.trim(shown(F.col(m.key))) if m.key else F.lit(None).cast("string")
    out = rows.select(F.col(number).cast("long").alias("row_number"), key.alias("row_key"), row_text(m).alias("document"), metadata_of(m).alias("metadata"))
    out = out.where("document != ''").withColumn("text_hash", text_hash(F.col("document"))).withColumn("metadata_hash", metadata_hash(F.col("metadata")))
    ident = F.when(F.coalesce(F.col("row_key"), F.lit("")) != "", F.concat(F.lit("key\0"), F.col("row_key"))).otherwise(F.concat(F.lit("row\0"), F.col("text_hash")))
    return out.withColumn("id", F.sha2(F.concat(F.lit(f"{source}\0{sheet}\0"), ident), 256))


def key_duplicates(rows: DataFrame, key: str, number: str = "row_number") -> DataFrame:
    """(value, rows): values of a key column on several rows, by their first."""
    return rows.where(F.col(key).isNotNull()).groupBy(shown(F.col(key)).alias("value")).agg(F.array_sort(F.collect_list(number)).alias("rows")).where(F.size("rows") > 1).orderBy(F.col("rows")[0])


def match_profiles(header: DataFrame, profiles: DataFrame) -> DataFrame:
    """(sheet, outcome, profile, missing, extra): the one profile whose columns the header has all, ambiguous, or the closest.

    ``header``: sheet, columns; ``profiles``: profile, columns. Both are small tables.
    """
    p = profiles.select("profile", F.col("columns").alias("wanted"))
    pairs = header.crossJoin(F.broadcast(p)).withColumn("missing", F.array_except("wanted", "columns")).withColumn("extra", F.array_except("columns", "wanted")).withColumn("shared", F.size(F.array_intersect("wanted", "columns")))
    claims = F.size("missing") == 0
    agg = pairs.groupBy("sheet").agg(F.count_if(claims).alias("n"), F.max_by(F.struct("profile", "missing", "extra"), F.struct(claims.cast("int"), "shared", F.col("profile"))).alias("best"))
    return agg.select("sheet", F.when(F.col("n") == 1, "match").when(F.col("n") > 1, "ambiguous").otherwise("closest").alias("outcome"), "best.*")


def markdown(rows: DataFrame, columns: list[str], order: str, group: str) -> DataFrame:
    """(group, text): each group's rows as a Markdown table, in order, pipes escaped. A group is a sheet that a reader sees."""
    cell = lambda c: F.replace(F.coalesce(F.regexp_replace(shown(F.col(c)), r"\s+", " "), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(group).agg(F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")).alias("text"))


def row_window(rows: DataFrame, at: int, around: int = 12, number: str = "row_number") -> DataFrame:
    return rows.where(F.col(number).between(at - around, at + around))


def spread_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Cells (row, col, value) with merged ranges (r0, c0, r1, c1) filled by their first cell's value."""
    each = merged.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    first = cells.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("_v"))
    filled = each.join(first, ["r0", "c0"]).select("row", "col", "_v")
    return cells.join(filled, ["row", "col"], "full").select("row", "col", F.coalesce("_v", "value").alias("value"))


def run_estimate(rows: DataFrame, m: Mapping, seconds_per_row: float) -> DataFrame:
    """(rows, characters, seconds) that embedding the table's rows would take."""
    t = row_text(m)
    return rows.agg(F.count_if(t != "").alias("rows"), F.sum(F.length(t)).alias("characters"), (F.count_if(t != "") * seconds_per_row).alias("seconds"))


def content_id(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def manifest_after(manifest: DataFrame, plan: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """The manifest (identity, document_id, row_number, text_hash, metadata_hash) once a plan is carried out.

    ``plan`` has the same columns and status: added, re_embedded and
    metadata_only rows replace what stood under their identity, ``retired``
    identities go, and rows that disappeared stay until somebody decides.
    """
    wrote = plan.where(F.col("status").isin("added", "re_embedded", "metadata_only")).select(*manifest.columns)
    kept = manifest.join(wrote.select("identity"), "identity", "left_anti")
    if retired is not None:
        kept = kept.join(retired.select("identity"), "identity", "left_anti")
    return kept.unionByName(wrote)


def sheet_sync(rows: DataFrame, m: Mapping, manifest: DataFrame, source: str, sheet: str) -> dict[str, DataFrame]:
    """What a sheet's rows ask of a collection that holds ``manifest`` (id, row_number, row_key, text_hash, metadata_hash).

    write: documents to embed and store; refresh: documents of which only
    metadata changed; disappeared: ids whose rows are gone, to be deleted once
    somebody confirms; plan: each row's status; manifest: what to keep for the
    next run if write and refresh are carried out.
    """
    from .sync import row_diff

    fresh = row_documents(rows, m, source, sheet)
    # both sides may be whole sheets, which Spark takes for small ones by the size of their compressed columns
    plan = row_diff(fresh, manifest)
    told = fresh.join(plan.where("row_number is not null").hint("shuffle_merge"), "row_number")
    gone = manifest.join(plan.where("status = 'disappeared'").select(F.col("old_row").alias("row_number")).hint("shuffle_merge"), "row_number", "left_semi")
    kept = told.where("status != 'duplicate'").select(*manifest.columns)
    return {
        "write": told.where(F.col("status").isin("added", "re_embedded")).drop("status", "old_row"),
        "refresh": told.where("status = 'metadata_only'").drop("status", "old_row"),
        "disappeared": gone.select("id"),
        "plan": plan,
        "manifest": kept.unionByName(gone.select(*manifest.columns)),
    }
