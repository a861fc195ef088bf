"""A Merkle manifest of a dataset: a tree of digests over each group's rows, one over the groups, and a proof for every row.

Rows become leaves where they are read, so only digests are dealt out. The leaves are put in order by
ranges, numbered within their group, and runs of `FANOUT` become nodes, level by level. Proofs come
from pointer jumping: a node starts with the siblings it has below its parent, and each round joins
the nodes with themselves at their ancestors, which doubles the distance to the ancestor and puts the
ancestor's siblings after the node's own, until the root is reached. The leaves of a run share what
lies above their parent, so they jump with it. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import written

FANOUT = 16
#: The tree over the groups' roots; groups are numbered from 0.
TOP = -1
#: About so many nodes meet one copy of their common ancestor in a task.
NODES_A_COPY = 4096

_KEY = ("tree", "level", "index")


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values as text: `-` for a null, else the UTF-8 byte count, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hash_all(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _run(number: str) -> Column:
    return F.floor(F.col(number) / FANOUT).cast("long")


def _numbered(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows in order by ranges, each with its `part` and place `at`; and for each part and group how many of the group come before, the first place, and the group's `size`.

    Ranges are dealt by the row's place in the input too, so that equal rows don't stay together.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    laid = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = written(laid.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counted = placed.groupBy("part", group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, written(counted.select("part", group, "first", before.alias("before"), F.sum("n").over(of_group).alias("size")))


def _indexed(placed: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """The placed rows with their `index` within the group, and the other columns of `parts`."""
    theirs = parts.withColumnsRenamed({"part": "_part", group: "_group"})
    met = placed.join(theirs, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn("index", F.col("at") - F.col("first") + F.col("before")).drop("part", "_part", "_group", "at", "first", "before")


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level above nodes of which their tree has several: (tree, level, index, count, digest, tall, children)."""
    child = F.struct(F.pmod(F.col("index"), F.lit(FANOUT)).cast("int").alias("pos"), *_KEY, "digest", "tall")
    met = nodes.filter("count > 1").groupBy("tree", (F.col("level") + 1).alias("above"), _run("index").alias("run"), F.ceil(F.col("count") / FANOUT).alias("left"))
    listed = met.agg(F.sort_array(F.collect_list(child)).alias("children"))
    return listed.select("tree", F.col("above").alias("level"), F.col("run").alias("index"), F.col("left").alias("count"), _hash_all(F.col("children.digest")).alias("digest"), (F.array_max("children.tall") + 1).alias("tall"), "children")


def _levels(first: DataFrame, most: int) -> list[DataFrame]:
    """`first` and the levels above it, written each; `most` is the largest number of nodes that a tree has in `first`."""
    levels = [first]
    while most > 1:
        levels.append(written(_parents(levels[-1])))
        most = -(-most // FANOUT)
    return levels


def _together(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _siblings(digests: Column, pos: Column, lone: Column) -> Column:
    """One step up: the digests left and right of a node in its run; no step from a node that is alone in its tree."""
    step = F.struct(F.array_join(F.slice(digests, 1, pos), "").alias("left"), F.array_join(F.slice(digests, pos + 2, FANOUT), "").alias("right"))
    return F.when(lone, F.array().cast("array<struct<left: string, right: string>>")).otherwise(F.array(step))


def _pointers(parents: DataFrame) -> DataFrame:
    """Every child of the parents with its key, the parent's (to_*), the step to it, and the group's root where the child is one."""
    lone = (F.col("tree") == TOP) & (F.col("level") == 1) & (F.col("count") == 1) & (F.size("children") == 1)
    each = parents.select(*(F.col(c).alias(f"to_{c}") for c in _KEY), lone.alias("lone"), F.col("children.digest").alias("digests"), F.explode("children").alias("child"))
    return each.select(
        *(F.col(f"child.{c}").alias(c) for c in _KEY),
        F.col("child.tall").alias("tall"),
        *(f"to_{c}" for c in _KEY),
        _siblings(F.col("digests"), F.col("child.pos"), F.col("lone")).alias("steps"),
        F.when((F.col("to_tree") == TOP) & (F.col("child.tree") != TOP), F.col("child.digest")).alias("subroot"),
    )


def _at_root(pointers: DataFrame, root_level: int, tall: int, rows: int) -> DataFrame:
    """The pointers after as many rounds of jumps as it takes for all to point at the root.

    Unfinished pointers reach exactly `far` levels up, so that an ancestor has up to FANOUT ** far of
    them; it is copied as often as they fill NODES_A_COPY, and each takes the copy of its key's hash.
    """
    far = 1
    ended = (F.col("to_tree") == TOP) & (F.col("to_level") == root_level)
    while far < tall:
        copies = max(1, min(FANOUT**far, rows) // NODES_A_COPY)
        salted = pointers.filter(~ended).withColumn("copy", F.pmod(F.xxhash64(*_KEY), F.lit(copies)).cast("int"))
        above = pointers.filter(F.col("tall") >= far).select(
            *(F.col(c).alias(f"at_{c}") for c in _KEY),
            *(F.col(f"to_{c}").alias(f"next_{c}") for c in _KEY),
            F.col("steps").alias("more"),
            F.col("subroot").alias("passed"),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("of_copy"),
        )
        same = (F.col("copy") == F.col("of_copy")) & (F.col("to_tree") == F.col("at_tree")) & (F.col("to_level") == F.col("at_level")) & (F.col("to_index") == F.col("at_index"))
        jumped = salted.join(above, same).select(
            *_KEY, "tall",
            *(F.col(f"next_{c}").alias(f"to_{c}") for c in _KEY),
            F.concat("steps", "more").alias("steps"),
            F.coalesce("subroot", "passed").alias("subroot"),
        )
        pointers = written(pointers.filter(ended).unionByName(jumped))
        far *= 2
    return pointers


PROOF = "leaf string, changed_leaf string, steps array<struct<left: string, right: string>>, subroot string, root string"


def merkle_proofs(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """(order column, leaf, changed_leaf, steps, subroot, root) for every row: its digest and its proof.

    The leaf is the `digest` of the fields. Within each group (null: one more) leaves ascend by the
    order column (null first), ties by leaf; equal rows are leaves each. While a group has several
    nodes, every FANOUT consecutive ones become the SHA-256 of their hex digests, the last run even
    if it is short or of one; a group of one leaf has that leaf as its subroot. Subroots, ordered by
    group (null first, bytewise), make the root in the same way. `steps` has, level by level from
    the leaf to the root, the concatenated hex digests left and right of the node in its run:
    `folded` of them and the leaf is the root. `changed_leaf` is `changed`, a column of `docs`'
    columns, or null. Null fields are part of the digest; texts of any length are hashed where they
    are read; an empty table gives no rows; columns not named here are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{order}`").alias("key"),
        F.col(f"`{group}`").alias("group"),
        digest(*(F.col(f"`{c}`") for c in fields)).alias("leaf"),
        (F.lit(None) if changed is None else changed).cast("string").alias("changed"),
    )
    placed, parts = _numbered(rows, "group", ["key", "leaf"])
    sizes = parts.groupBy("group").agg(F.first("size").alias("size")).withColumn("all", F.lit(0))
    groups = written(_indexed(*_numbered(sizes.withColumnRenamed("size", "n"), "all", ["group"]), "all").select("group", F.col("index").alias("tree"), F.col("size").alias("groups"), "n"))
    total = groups.agg(F.max("n"), F.sum("n"), F.count("*")).first()
    if not total[2]:
        return spark.createDataFrame([], f"`{order}` {dict(rows.dtypes)['key']}, {PROOF}")
    trees = parts.join(groups.select(F.col("group").alias("_g"), "tree"), F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
    leaves = _indexed(placed, trees, "group")
    member = F.struct(F.pmod(F.col("index"), F.lit(FANOUT)).cast("int").alias("pos"), "leaf", "changed", "key")
    runs = leaves.groupBy("tree", _run("index").alias("index"), "size").agg(F.sort_array(F.collect_list(member)).alias("leaves"))
    alone = F.col("size") == 1
    bottom = written(
        runs.select(
            "tree", F.lit(1).alias("level"), "index", F.ceil(F.col("size") / FANOUT).alias("count"),
            F.when(alone, F.col("leaves")[0]["leaf"]).otherwise(_hash_all(F.col("leaves.leaf"))).alias("digest"),
            F.lit(0).alias("tall"), alone.alias("alone"), "leaves",
        )
    )
    below = _levels(bottom.drop("alone", "leaves"), -(-total[0] // FANOUT))
    subroots = _together([x.filter("count = 1").drop("children") for x in below])
    # the top tree's leaves are the subroots, at their groups' numbers
    child = F.struct(F.pmod(F.col("tree"), F.lit(FANOUT)).cast("int").alias("pos"), *_KEY, "digest", "tall")
    several = total[2] > 1
    first = subroots.groupBy(_run("tree").alias("run")).agg(F.sort_array(F.collect_list(child)).alias("children"))
    first = first.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(1).alias("level"), F.col("run").alias("index"), F.lit(-(-total[2] // FANOUT)).cast("long").alias("count"),
        (_hash_all(F.col("children.digest")) if several else F.col("children")[0]["digest"]).alias("digest"),
        (F.array_max("children.tall") + 1).alias("tall"), "children",
    )
    tops = _levels(written(first), -(-total[2] // FANOUT))
    root = tops[-1].select("digest", "level", "tall").first()
    linked = written(_together([_pointers(x.drop("digest", "tall")) for x in [*below[1:], *tops]]))
    linked = _at_root(linked, root["level"], root["tall"], -(-total[1] // FANOUT) + total[2])
    above = linked.filter((F.col("tree") != TOP) & (F.col("level") == 1)).select("tree", "index", F.col("steps").alias("above"), "subroot")
    met = bottom.join(above, ["tree", "index"]).select("alone", F.col("leaves.leaf").alias("digests"), "above", "subroot", F.explode("leaves").alias("own"))
    return met.select(
        F.col("own.key").alias(order),
        F.col("own.leaf").alias("leaf"),
        F.col("own.changed").alias("changed_leaf"),
        F.concat(_siblings(F.col("digests"), F.col("own.pos"), F.col("alone")), F.col("above")).alias("steps"),
        "subroot",
        F.lit(root["digest"]).alias("root"),
    )


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings_digest(steps: Column) -> Column:
    """The SHA-256 of all siblings' hex digests, level by level, left to right."""
    return _hash_all(F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


def oracle_sql(levels: int = 8) -> str:
    """The rows of op11 in DuckDB's SQL; up to 16 ** levels leaves in a source and as many sources."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    head = " || ".join(map(part, ("doc_id", "source", "lang", "n_chars")))
    sql = f"""
WITH bytes AS (SELECT *, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM documents),
crcs AS (
  SELECT * EXCLUDE (b), xor(list_reduce(b, lambda c, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
    lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(c, x)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM bytes
),
rows AS (
  SELECT doc_id, source, sha256({head} || {part("text")}) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256({head} || {part(f"translate(text, '{upper}', '{lower}')")}) END AS changed FROM crcs
),
l0 AS (
  SELECT doc_id, leaf, coalesce(changed, leaf) AS f, '' AS p, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows
),
n0 AS (SELECT t, i, leaf AS d, count(*) OVER (PARTITION BY t) AS n FROM l0)"""

    def up(k: int, key: str, above: str = "") -> str:
        """Level k + 1 of nodes and what the leaves have gathered up to it; `key` names the tree, `above` what leaves carry besides."""
        run = f"r{above}{k}"
        return f""",
{run} AS (SELECT {key}, i // 16 AS i, n, string_agg(d, '' ORDER BY i) AS r, min(d) AS lone FROM n{above}{k} GROUP BY {key}, i // 16, n),
n{above}{k + 1} AS (SELECT {key}, i, CASE WHEN n = 1 THEN lone ELSE sha256(r) END AS d, (n + 15) // 16 AS n FROM {run}),
l{above}{k + 1} AS (
  SELECT l.* REPLACE (CASE WHEN n = 1 THEN f ELSE sha256(substr(r, 1, 64 * (l.i % 16)) || f || substr(r, 64 * (l.i % 16) + 65)) END AS f,
                      CASE WHEN n = 1 THEN p ELSE p || substr(r, 1, 64 * (l.i % 16)) || substr(r, 64 * (l.i % 16) + 65) END AS p, l.i // 16 AS i)
  FROM l{above}{k} l JOIN {run} x ON l.{key} = x.{key} AND l.i // 16 = x.i
)"""

    for k in range(levels):
        sql += up(k, "t")
    sql += f""",
lz0 AS (SELECT l.doc_id, l.leaf, l.f, l.p, x.d AS subroot, 0 AS z, l.t AS i FROM l{levels} l JOIN n{levels} x ON l.t = x.t),
nz0 AS (SELECT 0 AS z, t AS i, d, count(*) OVER () AS n FROM n{levels})"""
    for k in range(levels):
        sql += up(k, "z", "z")
    return sql + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = d AS verified FROM lz{levels} JOIN nz{levels} ON lz{levels}.z = nz{levels}.z
"""
