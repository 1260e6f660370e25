"""Schemas that drift between the files of a feed.

Every file gets a versioned fingerprint (a hash of its field paths and types, and the first file of the feed that had
the same).  The difference between one version and the next is a list of explicit migration steps (renamed, retyped,
added, removed).  Chaining the rename steps back to the first version, by pointers that double their reach each round,
gives each file the rules (source field, cast) by which its records are routed into one table; fields without a column
of their own go along under their first name, and what no rule can cast is recorded.

All parsing is done by Spark's variant functions inside whole-stage codegen; nothing is collected.  Records are parsed
once into a table of fields, of which each step reads the columns it needs.  Field counts are aggregated map-side to
one row per (file, path, type).  Values are hashed, and only those of fields that could
be a rename are shuffled, keyed by record id.

Defined results: lines that aren't a JSON object (null, empty, cut off, trailing text) are no records; a leading
byte-order mark is dropped; a line loaded more than once counts once (the earliest load); a file without any record
has no fields; a file without feed has no file before it; an empty table gives no rows; columns other than those
named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import cut, distinct_names

PRESENT_SHARE = 0.1
BOM = "\ufeff"


def records(lines: DataFrame) -> DataFrame:
    """One row per JSON record: feed, file_name, written_on, line_no, line (without byte-order mark), rec (variant)."""
    lines = distinct_names(lines, ["line_id", "feed", "file_name", "written_on", "line_no", "line", "loaded_at"])
    once = (
        lines.where(F.col("file_name").isNotNull())
        .groupBy("file_name", "line_no")
        .agg(
            F.min_by(
                F.struct("feed", "written_on", "line"),
                F.struct(F.coalesce("loaded_at", F.lit("9999-01-01").cast("timestamp")), F.coalesce("line_id", F.lit(2**62)), F.coalesce("line", F.lit(""))),
            ).alias("r")
        )
        .select("file_name", "line_no", "r.feed", "r.written_on", F.trim(F.ltrim("r.line", F.lit(BOM))).alias("line"))
    )
    return once.where(F.col("line").startswith("{") & F.col("line").endswith("}")).withColumn("rec", F.try_parse_json("line")).where("rec is not null")


#: JSON types by the first letters of a variant's schema; all else is a number.
_KINDS = "map('STRI', 'string', 'BOOL', 'boolean', 'ARRA', 'array', 'OBJE', 'object', 'VOID', 'null')"


def _kind(schema: str) -> str:
    return f"coalesce({_KINDS}[left({schema}, 4)], 'number')"


def top_fields(recs: DataFrame) -> DataFrame:
    """One row per record and top-level field, written to the shared folder so that records are parsed once: file_name,
    line_no, rid, path, kind, j (the value as JSON with sorted keys), one (true once a record).  A record without
    fields gives one row with a null path."""
    spark = recs.sparkSession
    rows = spark.sql(
        """SELECT file_name, line_no, to_json(variant_get(rec, '$.id')) AS rid, e.key AS path, schema_of_variant(e.value) AS t, to_json(e.value) AS j, coalesce(e.pos, 0) = 0 AS one
           FROM {recs}, LATERAL variant_explode_outer(rec) e""",
        recs=recs,
    )
    return cut(rows.selectExpr("file_name", "line_no", "rid", "path", f"{_kind('t')} AS kind", "j", "one"), "fields")


def field_values(top: DataFrame) -> DataFrame:
    """One row per record and non-null field: file_name, line_no, rid, path, parent, kind, vhash.

    ``a[].b`` has one row per record; its hash covers the values of all elements in order, and its kind is that
    of the first element that holds it.  ``id`` is left out.
    """
    spark = top.sparkSession
    top = top.where("path is not null and path <> 'id' and kind <> 'null'")
    flat = top.select("file_name", "line_no", "rid", "path", F.lit(None).cast("string").alias("parent"), "kind", F.xxhash64("kind", "j").alias("vhash"))
    inside = lambda kind: top.where(F.col("kind") == kind).select("file_name", "line_no", "rid", F.col("path").alias("parent"), F.try_parse_json("j").alias("v"))
    fields = "e.key AS name, schema_of_variant(e.value) AS t, to_json(e.value) AS j"
    inner = spark.sql(f"SELECT file_name, line_no, rid, parent, {fields} FROM {{objects}}, LATERAL variant_explode(v) e WHERE e.key IS NOT NULL", objects=inside("object"))
    inner = inner.selectExpr("file_name", "line_no", "rid", "concat(parent, '.', name) AS path", "parent", f"{_kind('t')} AS kind", "j").where("kind <> 'null'")
    elements = spark.sql("SELECT file_name, line_no, rid, parent, e.pos AS nth, e.value AS v FROM {arrays}, LATERAL variant_explode(v) e WHERE schema_of_variant(e.value) LIKE 'OBJECT%'", arrays=inside("array"))
    of_elements = spark.sql(f"SELECT file_name, line_no, rid, parent, nth, {fields} FROM {{elements}}, LATERAL variant_explode(v) e WHERE e.key IS NOT NULL", elements=elements)
    of_elements = (
        of_elements.selectExpr("file_name", "line_no", "rid", "concat(parent, '[].', name) AS path", "parent", "nth", f"{_kind('t')} AS kind", "j")
        .where("kind <> 'null'")
        .groupBy("file_name", "line_no", "rid", "path", "parent")
        .agg(F.min_by("kind", "nth").alias("kind"), F.sum(F.shiftright(F.xxhash64("nth", "kind", "j"), 12)).alias("vhash"))
    )
    return flat.unionByName(inner.select("file_name", "line_no", "rid", "path", "parent", "kind", F.xxhash64("kind", "j").alias("vhash"))).unionByName(of_elements)


def fingerprints(top: DataFrame, values: DataFrame, lines: DataFrame, share: float = PRESENT_SHARE) -> tuple[DataFrame, DataFrame]:
    """(versions, fields).  versions: feed, file_name, version (0 for the first file of the feed), n.
    fields: feed, version, file_name, path, parent, kind – those that at least ``share`` of the file's records hold."""
    files = (
        distinct_names(lines, ["feed", "file_name", "written_on"]).where(F.col("file_name").isNotNull()).groupBy("file_name").agg(F.min("feed").alias("feed"), F.min("written_on").alias("written_on"))
    )
    n = top.groupBy("file_name").agg(F.count_if("one").alias("n"))
    versions = files.join(n, "file_name", "left").select(
        "feed", "file_name", F.coalesce("n", F.lit(0)).alias("n"), (F.row_number().over(Window.partitionBy("feed").orderBy("written_on", "file_name")) - 1).alias("version")
    )
    by_kind = values.groupBy("file_name", "path", "parent", "kind").agg(F.count("*").alias("c"))
    fields = by_kind.groupBy("file_name", "path", "parent").agg(F.sum("c").alias("c"), F.max_by("kind", F.struct("c", "kind")).alias("kind"))
    fields = fields.join(versions, "file_name").where(F.col("c") >= F.lit(share) * F.col("n")).select("feed", "version", "file_name", "path", "parent", "kind")
    return versions, fields


def schema_versions(lines: DataFrame, share: float = PRESENT_SHARE) -> DataFrame:
    """One row per file: feed, file_name, version, records, fields, fingerprint (of its fields' paths and types; null
    for a file without fields), first_version (the feed's first version with the same fingerprint)."""
    top = top_fields(records(lines))
    versions, fields = fingerprints(top, field_values(top), lines, share)
    term = F.xxhash64("path", "kind")
    print_ = F.xxhash64(F.sum(F.shiftright(term, 32)), F.sum(term.bitwiseAND(F.lit(0xFFFFFFFF))), F.count("*"))
    hashed = fields.groupBy("file_name").agg(F.count("*").alias("fields"), print_.alias("fingerprint"))
    known = cut(versions.join(hashed, "file_name", "left"), "prints")
    first = known.where("fingerprint is not null").groupBy("feed", "fingerprint").agg(F.min("version").alias("first_version"))
    return known.join(first, ["feed", "fingerprint"], "left").select("feed", "file_name", "version", F.col("n").alias("records"), F.coalesce("fields", F.lit(0)).alias("fields"), "fingerprint", "first_version")


def changes(lines: DataFrame, share: float = PRESENT_SHARE) -> DataFrame:
    """Migration steps: feed, version, file_name, path, change_kind, new_value (see the module's head)."""
    return _changes(lines, top_fields(records(lines)), share)[0]


def _changes(lines: DataFrame, top: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    values = field_values(top)
    versions, fields = fingerprints(top, values, lines, share)
    versions, fields = cut(versions, "versions"), cut(fields, "fields")
    before = fields.select("feed", (F.col("version") + 1).alias("version"), "path", "parent", F.col("kind").alias("old_kind"), F.col("file_name").alias("old_file"))
    now = fields.select("feed", "version", "path", F.col("parent").alias("parent_now"), F.col("kind").alias("new_kind"))
    pairs = versions.where("version > 0").select("feed", "version", "file_name").join(versions.select("feed", (F.col("version") + 1).alias("version"), F.col("file_name").alias("prev_file")), ["feed", "version"])
    both = before.join(now, ["feed", "version", "path"], "full").join(pairs, ["feed", "version"])
    diff = both.select(
        "feed", "version", "file_name", "prev_file", "path", F.coalesce("parent", "parent_now").alias("parent"),
        F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").otherwise("retyped").alias("change_kind"),
        F.coalesce("old_kind", F.lit("")).alias("old_kind"), F.coalesce("new_kind", F.lit("")).alias("new_kind"),
    ).where("old_kind <> new_kind")
    top = diff.where("parent is null").select("feed", "version", F.col("path").alias("parent"))
    diff = cut(diff.where("parent is null").unionByName(diff.where("parent is not null").join(top, ["feed", "version", "parent"], "left_anti")), "diff")

    # renames: values of removed and of added fields, joined by record id
    gone, new = diff.where("change_kind = 'removed'"), diff.where("change_kind = 'added'")
    old_values = values.join(gone.select(F.col("prev_file").alias("file_name"), "path", "feed", "version"), ["file_name", "path"]).where("rid is not null and rid <> 'null'")
    new_values = values.join(new.select("file_name", "path", "feed", "version"), ["file_name", "path"]).where("rid is not null and rid <> 'null'")
    once = lambda v, name: v.groupBy("feed", "version", "rid", "path").agg(F.min("vhash").alias(f"{name}_hash")).withColumnRenamed("path", f"{name}_path")
    scored = (
        once(old_values, "old")
        .join(once(new_values, "new"), ["feed", "version", "rid"])
        .groupBy("feed", "version", "old_path", "new_path")
        .agg(F.count("*").alias("n"), F.count_if(F.col("old_hash") == F.col("new_hash")).alias("same"))
        .where("2 * same > n")
    )
    best = lambda one, other: F.row_number().over(Window.partitionBy("feed", "version", one).orderBy(F.desc("same"), F.desc(F.col("same") / F.col("n")), other))
    renames = cut(scored.withColumn("ro", best("old_path", "new_path")).withColumn("rn", best("new_path", "old_path")).where("ro = 1 and rn = 1").select("feed", "version", "old_path", "new_path"), "renames")
    plain = diff.join(renames.select("feed", "version", F.col("old_path").alias("path"), F.lit("removed").alias("change_kind")), ["feed", "version", "path", "change_kind"], "left_anti").join(
        renames.select("feed", "version", F.col("new_path").alias("path"), F.lit("added").alias("change_kind")), ["feed", "version", "path", "change_kind"], "left_anti"
    )
    renamed = renames.join(gone.withColumnRenamed("path", "old_path"), ["feed", "version", "old_path"]).select(
        "feed", "version", "file_name", F.col("old_path").alias("path"), F.lit("renamed").alias("change_kind"), F.col("new_path").alias("new_value")
    )
    steps = plain.select("feed", "version", "file_name", "path", "change_kind", F.when(F.col("change_kind") == "retyped", F.col("new_kind")).otherwise("").alias("new_value")).unionByName(renamed)
    return steps, versions, fields


#: Columns of the merged table, and the fields below them that casts need.
TARGETS = ["source_text", "messages", "conversations", "instruction"]
PARTS = {"messages": ("role", "content"), "conversations": ("from", "value")}


def lineages(versions: DataFrame, fields: DataFrame, steps: DataFrame) -> DataFrame:
    """Every field of every file with the field it descends from: feed, version, path, parent, v0, path0.

    A field comes from that of the version before that a step renames to it, that lies below a renamed field, or that
    has its name.  Ancestors are found by pointers: each round a field takes over the pointer of the field it points
    to, so rounds grow with the logarithm of the number of versions."""
    node = fields.select("feed", "version", "path", "parent")
    moved = steps.where("change_kind = 'renamed'").select("feed", "version", F.col("path").alias("was"), F.col("new_value").alias("now"))
    old = fields.select("feed", (F.col("version") + 1).alias("version"), F.col("path").alias("was"), "parent")
    by_name = old.join(moved, ["feed", "version", "was"], "left")
    above = moved.select("feed", "version", F.col("was").alias("parent"), F.col("now").alias("parent_now"))
    to = by_name.join(above, ["feed", "version", "parent"], "left").select(
        "feed", "version", "was", F.when(F.col("now").isNotNull(), F.col("now")).when(F.col("parent_now").isNotNull(), F.concat("parent_now", F.expr("substring(was, length(parent) + 1)"))).otherwise(F.col("was")).alias("path"),
        F.when(F.col("now").isNotNull(), 0).when(F.col("parent_now").isNotNull(), 1).otherwise(2).alias("how"),
    )
    from_ = to.groupBy("feed", "version", "path").agg(F.min(F.struct("how", "was"))["was"].alias("was"))
    own = F.col("was").isNull()
    at = cut(node.join(from_, ["feed", "version", "path"], "left").select("feed", "version", "path", "parent", F.when(own, F.col("version")).otherwise(F.col("version") - 1).alias("v0"), F.coalesce("was", "path").alias("path0")), "lineage")
    reach, longest = 1, versions.agg(F.max("version")).first()[0] or 0
    while reach < longest:
        far = at.select("feed", F.col("version").alias("v0"), F.col("path").alias("path0"), F.col("v0").alias("v1"), F.col("path0").alias("path1"))
        at = cut(at.join(far, ["feed", "v0", "path0"]).select("feed", "version", "path", "parent", F.col("v1").alias("v0"), F.col("path1").alias("path0")), "lineage")
        reach *= 2
    return at


def rules(versions: DataFrame, fields: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per file: file_name, version, rule (map from a column, or a column's part, to the field of the file it
    comes from), names (map from other top-level fields to their first names)."""
    key = ["feed", "v0", "path0"]
    line = cut(lineages(versions, fields, steps), "lineages")
    tops = line.where("parent is null")
    wanted = tops.where(F.col("path").isin(TARGETS)).select(*key, F.col("path").alias("target")).distinct()
    whole = tops.join(wanted, key).select("feed", "version", "target", "path")
    # parts: fields below any name that the column's field has had
    asked = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(k).alias("key")) for t, ks in PARTS.items() for k in ks])).alias("a")
    parts = whole.where(F.col("target").isin(list(PARTS))).select("feed", "target", "path").distinct().select("feed", F.col("target").alias("t"), "path", asked).where("a.target = t").select("feed", "t", "a.key", F.concat("path", F.lit("[]."), "a.key").alias("path"))
    part_lines = line.where("parent is not null").join(parts, ["feed", "path"]).select(*key, "t", "key").distinct()
    part_at = line.join(part_lines, key).groupBy("feed", "version", "t", "key").agg(F.min(F.expr("substring_index(path, '[].', -1)")).alias("name"))
    # where the array is wrapped in an object its fields aren't listed; they stay as they were
    here = whole.select("feed", "version", F.col("target").alias("t")).distinct().select("feed", "version", "t", asked).where("a.target = t").select("feed", "version", "t", "a.key")
    upto = Window.partitionBy("feed", "t", "key").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    part_rules = here.join(part_at, ["feed", "version", "t", "key"], "left").select("feed", "version", F.concat("t", F.lit("."), "key").alias("target"), F.coalesce(F.last("name", ignorenulls=True).over(upto), "key").alias("path"))
    each = whole.groupBy("feed", "version", "target").agg(F.min("path").alias("path")).unionByName(part_rules)
    rule = each.groupBy("feed", "version").agg(F.map_from_entries(F.collect_list(F.struct("target", "path"))).alias("rule"))
    names = tops.groupBy("feed", "version").agg(F.map_from_entries(F.collect_list(F.struct("path", "path0"))).alias("names"))
    return versions.join(rule, ["feed", "version"], "left").join(names, ["feed", "version"], "left").select("file_name", "version", "rule", "names")


def merged(lines: DataFrame, share: float = PRESENT_SHARE) -> DataFrame:
    """Every record of every file in one table: feed, file_name, version, line_no, id, source_text, messages,
    conversations (JSON array of {from, value}), instruction, others (every other top-level field: the first name of its
    lineage, its name in the file, its value, JSON where it is no string), lost (columns whose value no rule could
    cast, with that value).

    Each file's records take the file's rules: the rename chain gives the source field, a cast rule brings its
    value to the column's type (string from array: its first element; string from object: its ``text``; array
    from object: its ``items``), a missing field becomes null, and so does a value that no rule can cast.
    """
    recs = cut(records(lines).drop("rec"), "records")
    steps, versions, fields = _changes(lines, top_fields(recs.withColumn("rec", F.try_parse_json("line"))), share)
    df = recs.join(rules(versions, fields, cut(steps, "steps")), "file_name", "left").withColumn("m", F.from_json("line", "map<string,string>"))
    raw = lambda t: F.col("m")[F.col("rule")[t]]

    def text(t: str):
        x = raw(t)
        return F.when(x.startswith("["), F.coalesce(F.get_json_object(x, "$[0]"), x)).when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.text"), x)).otherwise(x)

    def turns(t: str):
        x = raw(t)
        x = F.when(x.startswith("{"), F.get_json_object(x, "$.items")).otherwise(x)
        name = lambda k: F.coalesce(F.col("rule")[f"{t}.{k}"], F.lit(k))
        return F.transform(F.from_json(x, "array<map<string,string>>"), lambda m: F.struct(*[m[name(k)].alias(k) for k in PARTS[t]]))

    empty = lambda t: F.col(t).isNull() | F.exists(t, lambda m: m[PARTS[t][0]].isNull() & m[PARTS[t][1]].isNull())
    lost = F.filter(F.array(*[F.when(raw(t).isNotNull() & empty(t), F.struct(F.lit(t).alias("field"), raw(t).alias("value"))) for t in PARTS]), lambda x: x.isNotNull())
    used = F.transform(F.array(*[F.lit(t) for t in TARGETS]), lambda t: F.col("rule")[t])
    others = F.transform(
        F.filter(F.array_sort(F.map_entries("m")), lambda e: (e["key"] != "id") & e["value"].isNotNull() & ~F.coalesce(F.array_contains(used, e["key"]), F.lit(False))),
        lambda e: F.struct(F.coalesce(F.col("names")[e["key"]], e["key"]).alias("field"), e["key"].alias("was"), e["value"].alias("value")),
    )
    cast = df.withColumns({"id": F.get_json_object("line", "$.id"), "source_text": text("source_text"), "messages": turns("messages"), "conversations": turns("conversations"), "instruction": text("instruction"), "others": others})
    return cast.withColumn("lost", lost).select("feed", "file_name", "version", "line_no", "id", "source_text", "messages", F.to_json("conversations").alias("conversations"), "instruction", "others", "lost")


def found(lines: DataFrame) -> DataFrame:
    return changes(lines).select("file_name", F.col("path").alias("field_path"), "change_kind", "new_value")
