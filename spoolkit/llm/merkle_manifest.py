"""A Merkle tree over a dataset, with a proof for every row.

Leaves are hashes of rows; those of each group, in order, are hashed in runs of
``arity``, level by level, and so are the groups' roots.

Bottom-up build: a stored table holds all nodes of a level, ``HEIGHT`` levels
apart, as blocks of ``arity ** HEIGHT`` consecutive nodes with the levels in
between; the tops of the blocks are the next table.  So a build takes one
shuffle for each HEIGHT levels, and no block is larger than any other, however
many rows one group holds.  Top-down push: from the last table on, blocks are
joined with the proof of their top, and each child prepends its siblings to it.
A proof never travels for single rows: the last blocks hold the leaves
themselves, and spread them out with their proofs in the task that writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolkit.llm.ordering import ranked
from spoolkit.storage import stored

#: Levels that one table spans.
HEIGHT = 6
_STEP = "array<struct<before:string,after:string>>"


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_hash(*values: Column) -> Column:
    return _hash(F.concat(*map(encoded, values)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, x: _hash(F.concat(x["before"], node, x["after"])))


def proof_hash(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return _hash(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""))


def _runs(nodes: Column, arity: int) -> Column:
    """The level above ``nodes``."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(starts, lambda i: _hash(F.array_join(F.slice(nodes, i * arity + 1, F.lit(arity)), "")))


def _blocks(nodes: DataFrame, sizes: DataFrame, arity: int, label: str) -> DataFrame:
    """``grp, block, steps, children, level_0 ...`` of nodes ``grp, pos, node, data``: each block's levels, as far as more than one node of the group remains."""
    wide = arity**HEIGHT
    # how often the group's level shrinks until one node remains, HEIGHT times at most
    left, steps = [F.col("nodes")], F.lit(0)
    for _ in range(HEIGHT):
        steps = steps + F.when(left[-1] > 1, 1).otherwise(0)
        left.append(F.floor((left[-1] + arity - 1) / arity))
    blocks = nodes.groupBy("grp", F.floor(F.col("pos") / wide).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", "data"))).alias("children"))
    out = blocks.join(sizes.select("grp", steps.alias("steps")), "grp").withColumn("level_0", F.transform("children", lambda x: x["node"]))
    for i in range(HEIGHT):
        out = out.withColumn(f"level_{i + 1}", F.when(F.col("steps") > i, _runs(F.col(f"level_{i}"), arity)))
    top = F.get(F.coalesce(*(F.col(f"level_{i}") for i in range(HEIGHT, -1, -1))), F.lit(0))
    return stored(out.withColumn("top", top), label)


def _steps(at: Column, arity: int) -> Column:
    """The siblings of the child at place ``at`` of its block, in each level of the block."""
    steps = []
    for i in range(HEIGHT):
        nodes, mine = F.col(f"level_{i}"), F.floor(at / arity**i).cast("int")
        start = (F.floor(mine / arity) * arity).cast("int")
        before = F.array_join(F.slice(nodes, start + 1, mine - start), "")
        after = F.array_join(F.slice(nodes, mine + 2, start + arity - mine - 1), "")
        steps.append(F.when(F.col("steps") > i, F.struct(before.alias("before"), after.alias("after"))))
    return F.array_compact(F.array(*steps))


def build(leaves: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The tables of all levels over leaves ``grp, pos, node, data`` (pos from 0 in each group), and each group's ``grp, subroot, depth`` (its last table)."""
    tables: list[DataFrame] = []
    tops: list[DataFrame] = []
    nodes = leaves
    while True:
        sizes = stored(nodes.groupBy("grp").agg(F.count("*").alias("nodes")), "sizes")
        tables.append(_blocks(nodes, sizes, arity, f"level_{len(tables)}"))
        last = F.col("nodes") <= arity**HEIGHT
        tops.append(tables[-1].join(sizes.where(last).select("grp"), "grp", "left_semi").select("grp", F.col("top").alias("subroot"), F.lit(len(tops)).alias("depth")))
        more = sizes.where(~last).select("grp")
        if more.isEmpty():
            break
        nodes = tables[-1].join(more, "grp", "left_semi").select("grp", F.col("block").alias("pos"), F.col("top").alias("node"), F.lit(None).cast(leaves.schema["data"].dataType).alias("data"))
    roots = tops[0]
    for part in tops[1:]:
        roots = roots.unionByName(part)
    return tables, stored(roots, "roots")


def push(tables: list[DataFrame], tops: DataFrame, arity: int = 2, *carried: str) -> DataFrame:
    """``data, node, *carried, proof`` for each leaf; ``tops`` has ``grp, depth, *carried, proof``: what each group's root inherits.

    A proof is an array of (before, after): what stands left and right of the
    node in its run, from the leaf up.
    """
    pushed = None
    for depth in range(len(tables) - 1, -1, -1):
        ends = tops.where(F.col("depth") == depth).select("grp", F.lit(0).cast("long").alias("block"), *carried, "proof")
        inherited = ends if pushed is None else ends.unionByName(pushed)
        spread = tables[depth].join(inherited, ["grp", "block"]).withColumn("child", F.explode("children"))
        proof = F.concat(_steps(F.col("child.pos") - F.col("block") * arity**HEIGHT, arity), F.col("proof"))
        if depth == 0:
            return spread.select("child.data", "child.node", *carried, proof.alias("proof"))
        pushed = stored(spread.select("grp", F.col("child.pos").alias("block"), *carried, proof.alias("proof")), "proofs")
    raise AssertionError("there is always a table of leaves")


def manifest(rows: DataFrame, id_column: str, fields: tuple[str, ...], group: str, tampered: dict[str, Column] | None = None, suspect: Column | None = None, arity: int = 2) -> DataFrame:
    """``id_column, leaf, subroot, root, proof, folded_root, verified`` for each row of ``rows``.

    A row's leaf is the hash of its ``fields``.  Leaves of one value of ``group``
    are in order of their id (nulls first), rows of one id in order of their
    leaves; groups are in order of their names (null first, by bytes).
    ``folded_root`` is what a row's own contents give with the siblings that the
    tree has; where ``suspect`` holds, ``tampered`` replaces fields first.
    ``verified`` says whether that is the root.

    Nulls in any field are told from empty texts.  Repeated rows are leaves of
    their own.  An empty table gives no rows; other columns are ignored.
    """
    changed = {**{f: F.col(f) for f in fields}, **(tampered or {})}
    again = F.when(suspect, row_hash(*(changed[f] for f in fields))) if suspect is not None else F.lit(None).cast("string")
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stored(rows.select(grp.alias("grp"), F.col(id_column).alias("id"), row_hash(*map(F.col, fields)).alias("node"), again.alias("again"), F.monotonically_increasing_id().alias("salt")), "leaves")
    placed = ranked(leaves, "grp", "id", "node", "salt").select("grp", "pos", "node", F.struct("id", "again").alias("data"))
    tables, subroots = build(placed, arity)
    named = ranked(subroots.withColumn("all", F.lit("")), "all", "grp").select(F.col("all").alias("grp"), "pos", F.col("subroot").alias("node"), F.struct(F.col("grp").alias("name"), "depth").alias("data"))
    upper, root = build(named, arity)
    nothing = F.array().cast(_STEP)
    groups = push(upper, root.select("grp", "depth", F.col("subroot").alias("root"), nothing.alias("proof")), arity, "root")
    tops = stored(groups.select(F.col("data.name").alias("grp"), F.col("data.depth").alias("depth"), F.col("node").alias("subroot"), "root", "proof"), "tops")
    found = push(tables, tops, arity, "subroot", "root").withColumn("folded_root", folded(F.coalesce("data.again", "node"), F.col("proof")))
    return found.select(F.col("data.id").alias(id_column), F.col("node").alias("leaf"), "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language; rows whose id's CRC-32 is divisible by seven are checked with one character more than they claim."""
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, "doc_id", ("doc_id", "source", "lang", "n_chars", "text"), "lang", {"n_chars": F.col("n_chars") + 1}, suspect)


_BYTES = "list_transform(range(1, length(t) + 1), lambda i: CAST(ascii(substr(t, i, 1)) AS UBIGINT))"

#: CRC-32 of a column ``t`` of ASCII text.
CRC_SQL = f"xor(list_reduce({_BYTES}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"

_ENCODED = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_ENCODED(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
_UP = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"

#: ``op13_merkle_manifest``: whole levels as lists.
ORACLE_SQL = f"""
WITH RECURSIVE crcs AS (
  SELECT t, {CRC_SQL} AS crc FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS t FROM documents)
), leaves AS (
  SELECT d.doc_id, coalesce('=' || lang, '') AS grp, {_LEAF("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_LEAF("n_chars + 1")} ELSE {_LEAF("n_chars")} END AS again
  FROM documents d LEFT JOIN crcs ON t = CAST(d.doc_id AS VARCHAR)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), lower AS (
  SELECT grp, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY grp
  UNION ALL SELECT grp, lvl + 1, {_UP} FROM lower WHERE len(nodes) > 1
), subroots AS (
  SELECT grp, nodes[1] AS subroot, lvl AS height, row_number() OVER (ORDER BY encode(grp)) - 1 AS place FROM lower WHERE len(nodes) = 1
), upper AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT lvl + 1, {_UP} FROM upper WHERE len(nodes) > 1
), steps AS (
  SELECT p.grp, p.pos, l.lvl, (p.pos >> l.lvl) % 2 = 1 AS left_of, coalesce(l.nodes[CAST(xor(p.pos >> l.lvl, 1) + 1 AS BIGINT)], '') AS sibling
  FROM placed p JOIN lower l ON l.grp = p.grp AND len(l.nodes) > 1
  UNION ALL SELECT p.grp, p.pos, s.height + u.lvl, (s.place >> u.lvl) % 2 = 1, coalesce(u.nodes[CAST(xor(s.place >> u.lvl, 1) + 1 AS BIGINT)], '')
  FROM placed p JOIN subroots s USING (grp) JOIN upper u ON len(u.nodes) > 1
), proofs AS (
  SELECT grp, pos, string_agg(sibling, '' ORDER BY lvl) AS siblings, list(CASE WHEN left_of THEN '<' ELSE '>' END || sibling ORDER BY lvl) AS path FROM steps GROUP BY ALL
), checked AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT nodes[1] FROM upper WHERE len(nodes) = 1) AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256,
    list_reduce(coalesce(q.path, []), lambda node, x: sha256(CASE WHEN x[1] = '<' THEN x[2:] || node ELSE node || x[2:] END), p.again) AS folded_root
  FROM placed p JOIN subroots s USING (grp) LEFT JOIN proofs q ON q.grp = p.grp AND q.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM checked"""
