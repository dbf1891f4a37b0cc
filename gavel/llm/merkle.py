"""A Merkle manifest of a dataset: a tree for each group of rows, one above the groups' roots, and proofs for every row.

Leaves are sha256 over the fields of a row. Places of leaves come from one
range-partitioned pass over (group, id, leaf), with counts of ranges as the
only thing that meets. Then every level is one equijoin: a node computes the
indices of its siblings (its own XOR 1 in binary trees, slots of its run of
`arity` otherwise), and each node joins with what its siblings sent it, which
gives the digests before and after it; the rows of slot zero emit the parents.
The level above a tree's subroots is made by the same steps. Each level is
written to the shared folder, so that a lost executor costs one level's tasks.
Proofs go down the same way: a node's path is its own siblings, followed by
its parent's path, so rows are joined with 1/arity as many parents, once.

A level's join has one row for each index and sender; no key is hot however
large one group is. What reaches the driver is the number of levels.

Defined results: null fields are `-`; rows of a null id come first in their
group and are never tampered with; rows of one id are ordered by their leaves
(equal ones are leaves of their own, interchangeable); a null group is one
group, the first; an empty table has no rows and no root; fields are taken by
name before any column is added, so that other columns' names don't matter.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.store import stored, width

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each as its number of UTF-8 bytes, a colon and its text; `-` for null."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def tampered_rows(doc_id: Column) -> Column:
    """Every third row or so, by crc32 of its id's decimal digits; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def leaves(rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", tamper: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, lang, leaf, tampered_leaf): the digest of each row, and that of its lower-cased text where `tamper` of the key says so."""
    cols = [F.col(c) for c in fields]
    changed = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in fields]
    other = F.when(tamper(F.col(key)), leaf_digest(changed)) if tamper else F.lit(None).cast("string")
    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(group).cast("string").alias("lang"), leaf_digest(cols).alias("leaf"), other.alias("tampered_leaf"))


def placed(found: DataFrame) -> DataFrame:
    """Leaves with tree (their group's rank), idx (the place in it) and n (the group's leaves), stored.

    One range of (group, id, leaf) is one task; ranges are counted by group, and the counts, one row for each range
    and group in it, are all that is put in order at once.
    """
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ranged = found.repartitionByRange(width(found, 64 << 20), *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    name = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("-"))
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("part"), row.alias("row"), name.alias("name")), "leaves", compression="zstd")
    counts = ranged.groupBy("part", "name").agg(F.count("*").alias("c"), F.min("row").alias("low"))
    whole = Window.partitionBy("name")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.dense_rank().over(Window.orderBy(F.col("name") != "-", "name")) - 1  # the null group comes first
    counts = counts.select("part", "name", rank.cast("long").alias("tree"), F.sum("c").over(whole).alias("n"), (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    at = ranged.join(counts, ["part", "name"])
    return stored(at.select("doc_id", "lang", "leaf", "tampered_leaf", "tree", (F.col("row") + F.col("shift")).alias("idx"), "n"), "places", compression="zstd")


def sibling_indices(idx: Column, arity: int) -> Column:
    """The indices of a node's possible siblings: idx XOR 1 in a binary tree, the other slots of its run otherwise."""
    if arity == 2:
        return F.array(idx.bitwiseXOR(F.lit(1).cast("long")))
    slot = F.pmod(idx, F.lit(arity))
    return F.array(*[idx - slot + F.pmod(slot + k, F.lit(arity)) for k in range(1, arity)])


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, idx, n, h) with `before` and `after`, the digests of their siblings on either side, by one equijoin of indices."""
    sent = nodes.select("tree", F.explode(sibling_indices(F.col("idx"), arity)).alias("idx"), F.col("idx").alias("sender"), F.col("h").alias("theirs"))
    met = nodes.join(sent, ["tree", "idx"], "left")
    near = F.array_sort(F.collect_list(F.when(F.col("theirs").isNotNull(), F.struct("sender", "theirs"))))  # arity - 1 at most
    held = met.groupBy("tree", "idx", "n", "h").agg(near.alias("near"))
    side = lambda keep: F.concat_ws("", F.transform(F.filter("near", keep), lambda x: x["theirs"]))
    return held.select("tree", "idx", "n", "h", side(lambda x: x["sender"] < F.col("idx")).alias("before"), side(lambda x: x["sender"] > F.col("idx")).alias("after"))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The parents (tree, idx, n, h) that the rows of slot zero emit: sha256 of their run."""
    up = lambda c: F.floor(c / arity).cast("long")
    zero = level.where(F.pmod(F.col("idx"), F.lit(arity)) == 0)
    return zero.select("tree", up(F.col("idx")).alias("idx"), up(F.col("n") + arity - 1).alias("n"), F.sha2(F.concat("h", "after"), 256).alias("h"))


def climb(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels (tree, idx, n, h, before, after) of all trees, each stored, and the roots (tree, h).

    nodes: (tree, idx, n, h), n being the number of nodes of their tree. A tree leaves when one node of it is left.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [nodes.where("n = 1").select("tree", "h")]
    while most > 1:
        levels.append(stored(siblings(nodes.where("n > 1"), arity), "level", compression="zstd"))
        nodes, most = parents(levels[-1], arity), -(-most // arity)
        tops.append(nodes.where("n = 1").select("tree", "h"))
    return levels, stored(functools.reduce(DataFrame.unionByName, tops), "roots")


def descend(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """above (tree, path, ..), of the roots, for all nodes of the lowest level: (tree, idx, path, ..), path beginning with a node's own siblings."""
    rest = [c for c in above.columns if c not in ("tree", "path")]

    def beyond(level: DataFrame | None) -> DataFrame:
        """The roots of trees that this level doesn't have."""
        roots = above if level is None else above.join(level.where("idx = 0").select("tree"), "tree", "left_anti")
        return roots.select("tree", F.lit(0).cast("long").alias("idx"), "path", *rest)

    paths = beyond(levels[-1] if levels else None)
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].select("tree", "idx", F.floor(F.col("idx") / arity).cast("long").alias("up"), F.array(F.struct("before", "after")).cast(_PATH).alias("own"))
        over = beyond(levels[k + 1] if k + 1 < len(levels) else None)
        over = over if k + 1 == len(levels) else over.unionByName(paths)
        paths = own.join(over.withColumnRenamed("idx", "up"), ["tree", "up"]).select("tree", "idx", F.concat("own", "path").alias("path"), *rest)
        paths = stored(paths, "paths", compression="zstd") if k else paths.unionByName(beyond(levels[0]))
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path make."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def manifest(rows: DataFrame, arity: int = ARITY, fields: tuple[str, ...] = FIELDS, tamper: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, lang, idx, leaf, tampered_leaf, subroot, root and path of each row."""
    found = placed(stored(leaves(rows, fields, tamper=tamper), "digests", compression="zstd"))
    levels, subroots = climb(found.select("tree", "idx", "n", F.col("leaf").alias("h")), arity)
    top = F.lit(0).cast("long").alias("tree")
    upper, root = climb(subroots.select(top, F.col("tree").alias("idx"), F.lit(subroots.count()).cast("long").alias("n"), "h"), arity)
    over = descend(upper, root.select("tree", F.array().cast(_PATH).alias("path")), arity).select(F.col("idx").alias("tree"), "path")
    above = stored(over.join(subroots.withColumnRenamed("h", "subroot"), "tree"), "above")
    # Rows meet their own siblings first, and the long paths of their parents, 1/arity as many, last.
    none = F.array().cast(_PATH)
    if levels:
        own = levels[0].select("tree", "idx", F.array(F.struct("before", "after")).cast(_PATH).alias("own"))
        found = found.join(own, ["tree", "idx"], "left").withColumn("own", F.coalesce("own", none))
    else:
        found = found.withColumn("own", none)
    up = descend(levels[1:], above, arity).withColumnRenamed("idx", "up")
    joined = found.withColumn("up", F.floor(F.col("idx") / arity).cast("long")).join(up, ["tree", "up"]).withColumn("path", F.concat("own", "path"))
    return joined.crossJoin(F.broadcast(root.select(F.col("h").alias("root")))).select("doc_id", "lang", "idx", "leaf", "tampered_leaf", "subroot", "root", "path")  # one root


def verified(proved: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of a manifest's rows: the tampered leaf, or else the original one, folded along its path."""
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda x: F.concat(x["before"], x["after"]))), 256)
    back = folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    return proved.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(levels: int = 8, upper: int = 3) -> str:
    """verified() of the test tables' documents in SQL, for groups of at most 8 ** levels rows and 8 ** upper groups; crc32 bit by bit."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END"
    digest = lambda text: "sha256(concat(" + ", ".join(field(text if c == "text" else c) for c in FIELDS) + "))"
    step = "xor(xor(a, b) >> 1, CASE WHEN xor(a, b) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    digits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda a, b: {step}), 4294967295)"
    sql = [f"""WITH leaf AS (SELECT doc_id, coalesce('+' || lang, '-') AS name, {digest('text')} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {digest(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM documents),
place AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf),
a0 AS (SELECT name, idx, leaf AS h, count(*) OVER (PARTITION BY name) AS n FROM place)"""]

    def tree(x: str, depth: int) -> None:
        for k in range(depth):
            run = f"OVER (PARTITION BY name, idx // {ARITY} ORDER BY idx ROWS BETWEEN"
            sql.append(f"""{x}s{k} AS (SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {x}{k} WHERE n > 1)""")
            sql.append(f"{x}{k + 1} AS (SELECT name, idx // {ARITY} AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, (n + {ARITY - 1}) // {ARITY} AS n FROM {x}{k} WHERE n > 1 GROUP BY ALL)")
        sql.append(f"{x}roots AS (" + " UNION ALL ".join(f"SELECT name, h FROM {x}{k} WHERE n = 1" for k in range(depth + 1)) + ")")

    tree("a", levels)
    sql.append("ranks AS (SELECT name AS lang_name, h AS subroot, row_number() OVER (ORDER BY name <> '-', name) - 1 AS rank FROM aroots), b0 AS (SELECT 'top' AS name, rank AS idx, subroot AS h, count(*) OVER () AS n FROM ranks)")
    tree("b", upper)
    sql.append("f0 AS (SELECT doc_id, leaf, subroot, rank, name, idx, coalesce(tampered, leaf) AS h, '' AS proof FROM place JOIN ranks ON name = lang_name)")
    steps = [(f"as{k}", "f.name", "f.idx", ARITY**k) for k in range(levels)] + [(f"bs{k}", "'top'", "f.rank", ARITY**k) for k in range(upper)]
    for k, (table, name, idx, span) in enumerate(steps):
        sql.append(f"""f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.h IS NULL THEN f.h ELSE sha256(concat(s.before, f.h, s.after)) END AS h, concat(f.proof, s.before, s.after) AS proof)
  FROM f{k} f LEFT JOIN {table} s ON s.name = {name} AND s.idx = {idx} // {span})""")
    return ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, broots.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = broots.h AS verified FROM f{len(steps)} f, broots"
