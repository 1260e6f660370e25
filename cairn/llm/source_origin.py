"""Generated, minified, vendored and data files among source code.

Merkle hashes are computed bottom-up: content rows give the file's hash, and every file's term, made of its depth below
the directory and its hash, goes up to all directories above it, so a directory's hash stands for its whole subtree at
whatever depth it stands.  Names don't enter, since copies are often renamed; neither do the head comment and blanks.
A subtree (file or directory) whose hash occurs in repositories of different owners is a shared copy: it is vendored
everywhere but in its origin, and so is every file below it, however short.  The origin is the repository that a
directory above one of the copies or a notice in one of them names, else, for subtrees of several contents, the one
that held it first (``indexed_at``).
A notice speaks for a directory if all its files carry it, or if the repository it names holds the same directory.
Copies in repositories of one owner only are no sign of anything.

Where the table doesn't hold the original, no hash can tell; there a notice at the head, or a directory named like
another repository, marks the file.  Header notices, name endings, directories and the layout of the text tell the
other classes.

All of it is column expressions, and paths of any depth take one shuffle.  Hashes are combined by sums of their two
halves, which are partially aggregated before each shuffle, so a repository or a directory of any size is no hot group.

Defined results: rows without repo or file_path belong to no file; a file of null contents only is judged by its
path; repeated rows count once; without ``indexed_at`` the first repository by name counts as the first holder; of
several classes the first of vendored, generated, minified, data_blob holds, but a file with signs of generation is
vendored only where an origin is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.runtime import cut, distinct_names

#: Least characters of a subtree, blanks and head comments aside, for its hash to mark a shared copy, and least different
#: contents where no origin is named: a single function that two projects share makes no copied file.
MIN_SHARED_CHARS, MIN_SHARED_PIECES = 80, 2
MIN_BLOB_CHARS = 400
BLOB_SHARE = 0.68
DENSE_LINE, DENSE_SPACE = 150, 0.075

#: The head of a text: blanks and comments of any length up to the first code.
HEAD = (
    r"\A(?:\s++|(?:#|//|--|;)[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)|<!--(?:[^-]|-(?!->))*+(?:-->|\z)"
    r"|\"\"\"(?:[^\"]|\"(?!\"\"))*+(?:\"\"\"|\z)|'''(?:[^']|'(?!''))*+(?:'''|\z))*+"
)
_SIGN = r"(?:#|//|/\*+!?|\*|--|;|<!--|\"\"\"|''')"
#: The first line of a head that says something.
_FIRST = r"(?i)\A(?:\s*+(?:/\*+|\"\"\"|''')?[ \t]*+\n|\s*+#![^\n]*+\n|\s*+#\s*+-\*-[^\n]*+\n)*+\s*+" + _SIGN + r"?[ \t*]*"
#: Any line of it.
_ANY = r"(?im)^[ \t]*+" + _SIGN + r"?[ \t*]*+"
#: Notices in the first line of a head, and those that open a later line of it.
GENERATED_NOTICE = (
    _FIRST + r"[^\n]*?"
    r"(?:@generated\b|<auto-?generated\b|\bcode generated\b|\b(?:auto-?\s?|machine-?\s?)generated\b(?![^\n]*\bstub\b)|\bmachine-made\b|\bautomatically (?:generated|produced|created|written)\b|\bgenerated (?:by|from|with|using|code|file)\b(?![^\n]*\bstub\b)"
    r"|\bthis file (?:was|is|has been) (?:produced|generated|created|written|built|emitted) (?:by|from|with)\b|\bdo not (?:edit|modify|change|touch)\b|\b(?:don't|don’t|never) (?:edit|modify)\b[^\n]*\b(?:hand|manual)|\bmanual changes will be (?:lost|overwritten)|\bchanges (?:made here )?will be (?:lost|overwritten)|\boutput of \w+[^\n]*\bsource of truth\b|\bproduced by \w+)"
)
GENERATED_LINE = _ANY + (
    r"(?:@generated\b|<auto-?generated\b|(?:this is )?(?:an? )?(?:auto-?|machine-?|automatically )generated (?:file|code|by|from|with)\b|code generated (?:by|from|with)\b|generated by (?:the )?\S+(?: v?[\d.]+)?[.,;:]? +do not edit\b"
    r"|this (?:file|code|module) (?:was|is|has been) (?:automatically |auto-?)?(?:generated|produced|emitted) (?:by|from|with|automatically)\b|(?:please )?do not (?:edit|modify)\b)"
)
VENDORED_NOTICE = (
    r"(?:\bvendored(?:\s*:|\s+(?:from|copy|in|code))|\bcopied (?:verbatim )?from \S+/\S+|\bcopied from (?:the )?\S+ (?:project|repo|repository|library)|\bthis (?:module|file|code|package) (?:belongs to|is (?:part|a copy) of|comes from|was (?:taken|copied|imported) from) (?:the )?[\w.\-/]+(?: project| library| package| repository)?\b[^\n]*(?:licen[cs]e|upstream|project)"
    r"|\bupstream\s*:\s*\S+|\bimported from upstream|\bthird[- ]party (?:code|source|library|module)\b|\btaken from https?://)"
)
VENDORED_FIRST, VENDORED_LINE = _FIRST + r"[^\n]*?" + VENDORED_NOTICE, _ANY + VENDORED_NOTICE
#: The project such a notice names.
_NAMED = r"(?i)(?:vendored\s*:?\s*(?:from|copy of)?\s*|copied (?:verbatim )?from (?:the )?|belongs to (?:the )?|part of (?:the )?|copy of (?:the )?|comes from (?:the )?|(?:taken|copied|imported) from (?:the )?|upstream\s*:\s*)(?:https?://)?(?:[\w.\-]+/)*([\w.\-]+)"
GENERATED_ENDING = r"(?i)(?:\.(?:gen|g|generated|pb|designer|autogen)\.[a-z]+|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts|d\.ts)|_(?:generated)\.[a-z]+|\.pb\.(?:go|cc|h))$"
GENERATED_DIR = r"(?i)(?:^|/)(?:generated|__generated__|autogen|autogenerated|generated[-_](?:src|sources|code)|gen)/"
MINIFIED_ENDING = r"(?i)[.\-]min\.[a-z]+$"
_LITERAL = r"\"[^\"\n]*+\"|'[^'\n]*+'|\b0[xX][0-9a-fA-F]++\b|-?\b\d[\d.eE_]*+\b|,"


def _short(repo: Column | str) -> Column:
    return F.element_at(F.split(repo, "/"), -1)


def _owner(repo: Column | str) -> Column:
    return F.substring_index(repo, "/", 1)


def _combined(term: Column) -> Column:
    """An order-free hash of all terms of a group, 64 bits wide; the halves are summed apart, so sums don't overflow."""
    return F.xxhash64(F.sum(F.shiftright(term, 32)), F.sum(term.bitwiseAND(F.lit(0xFFFFFFFF))), F.count("*"))


def _generated() -> Column:
    return F.col("gen") | F.col("file_path").rlike(GENERATED_ENDING) | F.col("file_path").rlike(GENERATED_DIR)


def _squeezed(text: Column) -> Column:
    for blank in (" ", "\n", "\t", "\r"):
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def file_facts(details: DataFrame) -> DataFrame:
    """One row per file: repo, file_path, hash (of its distinct contents without head comments and blanks), pieces (their
    number), size (their characters), chars, literal, space and line counts, first (least indexed_at), and whether a notice of generation
    or of another project stands at the head of one of its rows, with the project it names."""
    dated = [c for c in ("indexed_at",) if c in details.columns]
    rows = distinct_names(details, ["repo", "file_path", "content", *dated]).where("repo is not null and file_path is not null")
    first = F.col("indexed_at").cast("timestamp") if dated else F.lit(None).cast("timestamp")
    read = rows.select("repo", "file_path", first.alias("first"), F.coalesce("content", F.lit("")).alias("t")).withColumn("head", F.regexp_extract("t", HEAD, 0)).withColumn("bare", _squeezed(F.col("t")))
    body = F.substring("bare", F.length(_squeezed(F.col("head"))) + 1, F.length("bare"))
    line = F.coalesce(F.nullif(F.regexp_extract("head", VENDORED_FIRST, 0), F.lit("")), F.nullif(F.regexp_extract("head", VENDORED_LINE, 0), F.lit("")))
    told = read.select(
        "repo", "file_path", "first", "t", body.alias("body"), F.length("t").alias("chars"), (F.length("t") - F.length("bare")).alias("space"),
        (F.col("head").rlike(GENERATED_NOTICE) | F.col("head").rlike(GENERATED_LINE)).alias("gen"), line.alias("notice"), "head",
    )
    once = (
        told.select(
            "repo", "file_path", "first", "chars", "space", "gen", F.col("notice").isNotNull().alias("ven"), F.when(F.col("notice").isNotNull(), F.regexp_extract("head", _NAMED, 1)).alias("named"),
            F.xxhash64("body").alias("h"), F.length("body").alias("size"),
            (F.col("chars") - F.length(F.regexp_replace("t", _LITERAL, ""))).alias("literal"), (F.regexp_count("t", F.lit(r"\n\s*+\S")) + 1).alias("lines"),
        )
        .groupBy("repo", "file_path", "h")
        .agg(F.min("first").alias("first"), *[F.max(c).alias(c) for c in ("gen", "ven", "named", "size", "chars", "literal", "space", "lines")])
    )
    return once.groupBy("repo", "file_path").agg(
        _combined(F.col("h")).alias("hash"), F.count("*").alias("pieces"), F.min("first").alias("first"), *[F.max(c).alias(c) for c in ("gen", "ven", "named")], *[F.sum(c).alias(c) for c in ("size", "chars", "literal", "space", "lines")]
    )


def _ancestors(files: DataFrame, *kept: str) -> DataFrame:
    """Every file with each directory above it: repo, file_path, path ('' is the root), below (directories between)."""
    parts = F.split("file_path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (F.size(parts) - 1 - k).alias("below")))
    return files.select("repo", "file_path", *kept, F.explode(up).alias("d")).select("repo", "file_path", *kept, "d.path", "d.below")


def merkle(files: DataFrame) -> DataFrame:
    """All directories: repo, path ('' is the root), hash, files, size, pieces, first, made (whether all its files show
    signs of generation), and the least and greatest project that
    notices of its files name, with the number of such files."""
    up = _ancestors(files.withColumns({"named": F.when(F.col("ven"), F.nullif("named", F.lit(""))), "made": _generated()}), "made", "hash", "size", "pieces", "first", "named")
    return up.groupBy("repo", "path").agg(
        _combined(F.xxhash64(F.lit("below"), "below", "hash")).alias("hash"), F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("pieces").alias("pieces"), F.min("first").alias("first"), F.min("made").alias("made"), F.min("named").alias("named_a"), F.max("named").alias("named_b"), F.count("named").alias("told")
    )


def shared_subtrees(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, shared).  nodes: hash, repo, path, is_file of all files and directories large enough to tell.
    shared: hash, shared_repos, origin (short name, null if none is named), holder (repository that held it first),
    unrelated (whether owners differ and there are pieces enough) of hashes in several repositories.  A copy with signs of generation is nobody's
    original, so it says neither who held it first nor whether owners differ."""
    own = F.when(F.col("ven"), F.nullif("named", F.lit("")))
    leaves = files.select("hash", "repo", F.col("file_path").alias("path"), F.lit(True).alias("is_file"), _generated().alias("made"), "first", "size", "pieces", F.lit(1).cast("long").alias("files"), own.alias("named_a"), own.alias("named_b"), F.when(own.isNotNull(), 1).otherwise(0).cast("long").alias("told"))
    tree = merkle(files).where("files > 1").withColumn("is_file", F.lit(False))
    nodes = cut(leaves.unionByName(tree.select(*leaves.columns)).where(F.col("size") >= MIN_SHARED_CHARS), "nodes")
    held = nodes.groupBy("hash", "repo").agg(F.min("first").alias("first"), F.min("made").alias("made"), F.max("pieces").alias("pieces"))
    far, owner = F.lit("9999-01-01").cast("timestamp"), F.when(~F.col("made"), _owner("repo"))
    shared = cut(
        held.groupBy("hash")
        .agg(F.count("*").alias("shared_repos"), F.min_by("repo", F.struct("made", F.coalesce("first", far), "repo")).alias("holder"), (F.coalesce(F.min(owner) != F.max(owner), F.lit(False)) & (F.max("pieces") >= MIN_SHARED_PIECES)).alias("unrelated"))
        .where("shared_repos > 1"),
        "shared",
    )
    # what directories and notices of the copies name, where it is a repository of the table
    copies = nodes.join(shared.select("hash"), "hash")
    names = files.select(_short("repo").alias("origin")).distinct()
    placed = copies.select("hash", "repo", F.explode(F.when(F.col("is_file"), F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))).otherwise(F.split("path", "/"))).alias("origin"), F.lit(True).alias("sure"))
    noticed = copies.select("hash", "repo", F.explode(F.array_distinct(F.array("named_a", "named_b"))).alias("origin"), (F.col("is_file") | ((F.col("told") == F.col("files")) & (F.col("named_a") == F.col("named_b")))).alias("sure")).where("origin is not null")
    holders = copies.select("hash", _short("repo").alias("origin"), F.lit(True).alias("holds")).distinct()
    named = placed.unionByName(noticed).where(F.col("origin") != _short("repo")).groupBy("hash", "origin").agg(F.max("sure").alias("sure")).join(names, "origin").join(holders, ["hash", "origin"], "left").where("sure or holds")
    best = named.groupBy("hash").agg(F.min(F.struct(F.coalesce("holds", F.lit(False)) == F.lit(False), "origin"))["origin"].alias("origin"))
    return nodes, shared.join(best, "hash", "left")


def classify(details: DataFrame) -> DataFrame:
    """One row per file: repo, file_path, file_class (null for hand-written), shared_repos (repositories that hold the
    same file or a directory above it), sign (what made it vendored: subtree, directory or notice)."""
    files = cut(file_facts(details), "files")
    nodes, shared = shared_subtrees(files)
    shared = cut(shared, "origins")
    copy = F.when(F.col("origin").isNotNull(), F.when(F.col("origin") != _short("repo"), "named")).when(F.col("unrelated") & (_owner("repo") != _owner("holder")), "first")
    marked = nodes.join(shared, "hash").select("repo", "path", "is_file", "shared_repos", copy.alias("copy"))
    leaves = marked.where("is_file").select("repo", F.col("path").alias("file_path"), "shared_repos", "copy", F.lit(1 << 20).alias("near"))
    dirs = _ancestors(files).join(marked.where("not is_file").drop("is_file"), ["repo", "path"]).select("repo", "file_path", "shared_repos", "copy", F.length("path").alias("near"))
    trees = leaves.unionByName(dirs).groupBy("repo", "file_path").agg(F.max("shared_repos").alias("shared_repos"), F.max_by("copy", F.when(F.col("copy").isNotNull(), F.col("near"))).alias("copy"))

    names = files.select(_short("repo").alias("name")).distinct()
    above = files.select("repo", "file_path", F.explode(F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))).alias("name")).where(F.col("name") != _short("repo"))
    placed = above.join(names, "name").groupBy("repo", "file_path").agg(F.lit(True).alias("placed"))
    own = files.join(trees, ["repo", "file_path"], "left").join(placed, ["repo", "file_path"], "left")

    chars = F.greatest("chars", F.lit(1))
    blob = (F.col("chars") >= MIN_BLOB_CHARS) & (F.col("literal") / chars >= BLOB_SHARE)
    dense = (F.col("chars") >= 200) & (F.col("chars") / F.greatest("lines", F.lit(1)) >= DENSE_LINE) & (F.col("space") / chars <= DENSE_SPACE)
    generated = _generated()
    noticed = F.col("ven") & (F.coalesce("named", F.lit("")) != "") & (F.lower("named") != F.lower(_short("repo")))
    sign = F.when((F.col("copy") == "named") | ((F.col("copy") == "first") & ~generated), "subtree").when(F.col("placed"), "directory").when(noticed, "notice")
    return own.withColumn("sign", sign).select(
        "repo", "file_path",
        F.when(F.col("sign").isNotNull(), "vendored")
        .when(generated, "generated")
        .when(F.col("file_path").rlike(MINIFIED_ENDING) | (dense & ~blob), "minified")
        .when(blob, "data_blob").alias("file_class"),
        F.coalesce("shared_repos", F.lit(1).cast("long")).alias("shared_repos"), "sign",
    )


def found(details: DataFrame) -> DataFrame:
    return classify(details).where("file_class is not null").select("repo", "file_path", "file_class")
