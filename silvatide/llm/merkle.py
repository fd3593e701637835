"""A Merkle manifest of a dataset, by supersteps over an RDD of tree nodes.

Rows are leaves; the leaves of a group (a language) ascend by id. While a level has several nodes, every FANOUT
consecutive ones (a run; the last may be shorter, even a single node) become their hash. What remains is the group's
subroot; the subroots, ordered by group, become the root in the same way.

A vertex is a block: the runs of STEP levels over SPAN consecutive nodes. In an upward superstep each node sends its
digest to its block, whose messages are combined before they are shuffled; a block that holds all the nodes it expects
hashes them, run by run and level by level, and its digest is a message of the next superstep. Downward, a block that
knows the way above it tells each of its nodes the runs on the way to the root. Leaves live with their block, so the
ways go to one vertex for every SPAN leaves and not to each. What a superstep leaves is written to the shared folder: a
lost executor costs a retry of that step. The number of supersteps is the height of the trees over STEP, so it grows
with the logarithm of the number of rows. To the driver come only the counts of the sorted partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import only, place, ship, swept, table, written

FANOUT = 8
#: Levels that a superstep climbs, and the nodes that one vertex of it holds at most.
STEP = 3
SPAN = FANOUT**STEP
#: Vertices of a partition in a superstep.
PER_PARTITION = 400
#: The tree over the subroots; the trees of the groups are numbered from 0.
TOP = -1

SCHEMA = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def hash_run(digests: list[bytes]) -> bytes:
    """The hash of a run: sha256 of its digests as hex text, one after another."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _levels(n: int) -> int:
    """Supersteps over n nodes; a single node has one that passes it on."""
    k = 1
    while n > SPAN:
        n, k = -(-n // SPAN), k + 1
    return k


def leaf_hash(*fields: Column) -> Column:
    """sha256 of the fields, each as its UTF-8 byte count, a colon and the value, or a dash where null."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _summary(rows: Iterator) -> Iterator[tuple]:
    """Of a sorted partition: rows, groups, first and last group with their rows, and the largest group."""
    first = last = None
    n = groups = head = run = most = 0
    for group, *_ in rows:
        if n == 0 or group != last:
            groups += 1
            if n == 0:
                first = group
            last, run = group, 0
        run += 1
        head += groups == 1
        most = max(most, run)
        n += 1
    yield n, groups, first, last, head, run, most


def _numbered(sums: list[tuple]) -> tuple[list[tuple[int, int, int, int]], int, int, int]:
    """For each sorted partition: number of its first group, rows of that group before it, and all rows of its first and of its last group; then
    rows, groups, and rows of the largest group. Groups that cross partitions are joined here, one step a partition."""
    total: dict[int, int] = {}
    out, g, most, ended = [], -1, 0, None
    for n, groups, first, last, head, tail, largest in sums:
        if not n:
            out.append((0, 0, 0, 0))
            continue
        joined = g >= 0 and first == ended
        at = g if joined else g + 1
        before = total.get(at, 0)
        total[at] = before + head
        g = at + groups - 1
        if groups > 1:
            total[g] = tail
        most, ended = max(most, largest), last
        out.append((at, before, at, g))
    full = [(a, b, total.get(first, 0), total.get(last, 0)) for a, b, first, last in out]
    return full, sum(s[0] for s in sums), g + 1, max([most, *total.values()])


def _messages(at: list[tuple]):
    """Leaves as messages to their blocks: ((group, 1, block), [(leaves of the group, place in the block, digest, (id, changed digest))])."""

    def run(part: int, rows: Iterator) -> Iterator[tuple]:
        number, before, all_first, all_last = at[part]
        held = None
        size, place = all_first, before
        # A group that lies inside the partition is counted first, so its leaves wait: a partition's rows at most.
        waiting: list[tuple] = []
        started = False

        def send(rows: list[tuple], n: int, g: int, start: int) -> Iterator[tuple]:
            for k, (doc_id, leaf, changed) in enumerate(rows):
                i = start + k
                yield (g, 1, i // SPAN), [(n, i % SPAN, leaf, (doc_id, changed))]

        g, first_group = number, True
        for group, doc_id, leaf, changed in rows:
            if started and group != held:
                yield from send(waiting, size if first_group else len(waiting), g, place)
                waiting, g, place, first_group = [], g + 1, 0, False
            held, started = group, True
            waiting.append((doc_id, bytes(leaf), bytes(changed) if changed is not None else None))
        if started:
            yield from send(waiting, size if first_group else all_last, g, place)

    return run


def _combined(messages: RDD, vertices: int) -> RDD:
    """Messages met at their vertex, at most SPAN at each; combined before the shuffle."""
    parts = max(1, -(-vertices // PER_PARTITION))
    return messages.reduceByKey(_joined, parts)


def _joined(a: list, b: list) -> list:
    a.extend(b)
    return a


def _closed(vertex: tuple) -> tuple:
    """A vertex with the number of nodes of its level, the nodes that it hashes level by level (its own first), its children in order, and its digest.
    All that it expects are there: a superstep ends when all messages are in."""
    key, got = vertex
    got = sorted(got, key=lambda m: m[1])
    n = got[0][0]
    if len(got) != min(SPAN, n - key[2] * SPAN):
        raise RuntimeError(f"block {key} has {len(got)} nodes")
    inner, left = [[m[2] for m in got]], n  # left: nodes of the whole level
    for _ in range(STEP):
        if left > 1:
            nodes, left = inner[-1], -(-left // FANOUT)
            inner.append([hash_run(nodes[k : k + FANOUT]) for k in range(0, len(nodes), FANOUT)])
    (digest,) = inner.pop() if len(inner) > 1 else inner[0]
    return key, n, inner, [m[3] for m in got], digest


def _steps(vertex: tuple, k: int, above: list) -> list:
    """The way from child k of a vertex: its place in its run and the run, level by level, then the way above the vertex."""
    _, n, inner, _, _ = vertex
    own = []
    for nodes in inner if n > 1 else []:
        first = k // FANOUT * FANOUT
        own.append((k - first, nodes[first : first + FANOUT]))
        k //= FANOUT
    return [*own, *above]


def _up(vertex: tuple) -> Iterator[tuple]:
    """What a closed vertex forwards to the next level of its tree; a tree's last vertex forwards nothing."""
    (tree, level, i), n, _, _, digest = vertex
    above = -(-n // SPAN)
    if above > 1:
        yield (tree, level + 1, i // SPAN), [(above, i % SPAN, digest, (tree, level, i))]


def _down(vertex: tuple, way: tuple) -> Iterator[tuple]:
    """What a vertex of the inside of a tree tells its children: their run and place, then its own way."""
    subroot, root, above = way
    for k, child in enumerate(vertex[3]):
        yield child, (subroot, root, _steps(vertex, k, above))


def _proved(vertex: tuple, way: tuple) -> Iterator[tuple]:
    """The rows of the leaves of a vertex: proof, and the root that each leaf folds to."""
    leaves = vertex[2][0]
    subroot, root, above = way
    for k, (doc_id, changed) in enumerate(vertex[3]):
        steps = _steps(vertex, k, above)
        proof = hashlib.sha256("".join(d.hex() for at, run in steps for j, d in enumerate(run) if j != at).encode()).hexdigest()
        folded = leaves[k] if changed is None else changed
        for at, run in steps:
            folded = hash_run([*run[:at], folded, *run[at + 1 :]])
        yield doc_id, leaves[k].hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root


def _saved(spark: SparkSession, rdd: RDD, name: str) -> RDD:
    """Write an RDD under the shared folder and read it back: this cuts the lineage and survives lost executors."""
    path = place(spark, name)
    rdd.saveAsPickleFile(path)
    return spark.sparkContext.pickleFile(path)


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of leaves (group, doc_id, leaf, changed).

    `leaf` is a binary digest; `changed`, if not null, is the digest that is folded in its place. Groups are ordered with null first, then by their bytes; rows of a
    group by id, null first, then by leaf, so repeated rows are nodes of their own beside each other. proof_sha256 is the
    hash of the siblings' hex digests from the leaf's run to the root's (of nothing, where there is none). An empty table gives no rows.
    """
    spark = leaves.sparkSession
    ship(spark)
    with swept(spark) as kept:
        slim = written(spark, leaves.select("group", "doc_id", "leaf", "changed", F.monotonically_increasing_id().alias("n")), "leaves")
        order = [F.col("group").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "n"]
        ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("group", "doc_id", "leaf", "changed").rdd
        at, rows, groups, most = _numbered(ordered.mapPartitions(_summary).collect())  # one row a partition
        if not rows:
            out = written(spark, spark.createDataFrame([], SCHEMA), "manifest")
            kept.append(out)
            return out
        # Upward through the trees of the groups, all at once.
        heights, levels = _levels(most), {}
        messages, vertices = ordered.mapPartitionsWithIndex(_messages(at)), rows // SPAN + groups
        for level in range(1, heights + 1):
            levels[level] = _saved(spark, _combined(messages, vertices).map(_closed), f"level{level}")
            messages, vertices = levels[level].flatMap(_up), vertices // SPAN + groups
        # Trees that are done forward their subroots to the top tree.
        ends = [v.filter(lambda v: v[1] <= SPAN).map(lambda v: ((TOP, 1, v[0][0] // SPAN), [(groups, v[0][0] % SPAN, v[4], v[0])])) for v in levels.values()]
        tops, messages, vertices = {}, spark.sparkContext.union(ends), groups // SPAN + 1
        for level in range(1, _levels(groups) + 1):
            tops[level] = _saved(spark, _combined(messages, vertices).map(_closed), f"top{level}")
            messages, vertices = tops[level].flatMap(_up), vertices // SPAN + 1
        # Downward: the root first, which has no way above it.
        last = max(tops)
        told = tops[last].flatMap(lambda v: _down(v, (None, v[4], [])))
        for level in range(last - 1, 0, -1):
            met = tops[level].map(lambda v: (v[0], v)).join(told, max(1, tops[level].getNumPartitions()))
            told = met.flatMap(lambda x: _down(*x[1]))
        entries = _saved(spark, told, "entries")  # one message to the last vertex of each group's tree
        told = None
        for level in range(heights, 0, -1):
            to = entries.filter(lambda m, level=level: m[0][1] == level)
            told = to if told is None else told.union(to)
            parts = max(1, min(-(-(rows // SPAN**level + groups) // PER_PARTITION), 1 << 20))
            met = levels[level].map(lambda v: (v[0], v)).join(told, parts).map(lambda x: (x[1][0], _entered(*x[1])))
            if level > 1:
                told = _saved(spark, met.flatMap(lambda x: _down(*x)), f"ways{level}")
        out = written(spark, spark.createDataFrame(met.flatMap(lambda x: _proved(*x)), SCHEMA, verifySchema=False), "manifest")
        kept.append(out)
    return out


def _entered(vertex: tuple, way: tuple) -> tuple:
    """The way of a vertex; where it comes from the top tree the vertex is its group's subroot."""
    return (vertex[4], *way[1:]) if way[0] is None else way


def tampered_text(text: Column) -> Column:
    """The text with A-Z lower-cased; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_leaves(docs: DataFrame) -> DataFrame:
    """group (the language), doc_id, leaf, and the tampered leaf where 3 divides the crc32 of the id's digits (never for a null id)."""
    d = only(docs, "doc_id", "source", "lang", "n_chars", "text")
    rest = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return d.select(F.col("lang").alias("group"), "doc_id", leaf_hash(*rest, F.col("text")).alias("leaf"), F.when(hit, leaf_hash(*rest, tampered_text(F.col("text")))).alias("changed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents. Null columns are dashes in the leaf's hash, an empty text is `0:`; a null language is a group of its own, before the
    others; ids that repeat are ordered by leaf, and repeated rows are leaves of their own; extra columns play no part. An empty table gives no rows."""
    return manifest(document_leaves(table(spark, sf_dir, "documents")))


def _oracle(levels: int = 9, tops: int = 4) -> str:
    """The same tree level by level, for up to 8**9 rows of a language and 8**4 languages; crc32 by its table of 256."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    rest = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    table_ = "list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, x: xor(crcs.t[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8)), 4294967295)"
    parts = [
        f"crcs AS MATERIALIZED (SELECT {table_} AS t)",
        f"d AS MATERIALIZED (SELECT doc_id, lang, sha256({rest} || {field('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256({rest} || {field(lower)}) END AS changed FROM documents CROSS JOIN crcs)",
        "g AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS g FROM (SELECT DISTINCT lang FROM d))",
        "l0 AS MATERIALIZED (SELECT g.g, row_number() OVER (PARTITION BY g.g ORDER BY doc_id IS NOT NULL, doc_id, leaf) - 1 AS i, doc_id, leaf AS h, changed FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang)",
        "p0 AS MATERIALIZED (SELECT g, i, i AS pos, doc_id, h AS leaf, coalesce(changed, h) AS f, '' AS s FROM l0)",
    ]
    siblings = "array_to_string(list_transform(list_filter(range(1, len(run) + 1), lambda k: k <> pos % 8 + 1), lambda k: run[k]), '')"
    folded = "sha256(array_to_string(list_transform(range(1, len(run) + 1), lambda k: CASE WHEN k = pos % 8 + 1 THEN f ELSE run[k] END), ''))"

    def level(k: int, node: str, way: str) -> None:
        """A level: runs r, nodes above them, and the rows' ways up to them. A level of one node stays as it is."""
        parts.append(f"r{node}{k} AS MATERIALIZED (SELECT g, i // 8 AS i, list(h ORDER BY i) AS run, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {node}{k}) GROUP BY g, i // 8)")
        parts.append(f"{node}{k + 1} AS MATERIALIZED (SELECT g, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM r{node}{k})")
        same = f"CASE WHEN n = 1 THEN f ELSE {folded} END"
        parts.append(f"{way}{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (pos, f, s), p.pos // 8 AS pos, {same} AS f, s || CASE WHEN n = 1 THEN '' ELSE {siblings} END AS s FROM {way}{k} p JOIN r{node}{k} r ON r.g = p.g AND r.i = p.pos // 8)")

    for k in range(levels):
        level(k, "l", "p")
    parts.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS i, h FROM l{levels})")
    parts.append(f"q0 AS MATERIALIZED (SELECT 0 AS g, p.g AS pos, doc_id, leaf, f, s, h AS subroot FROM p{levels} p JOIN l{levels} l ON l.g = p.g)")
    for k in range(tops):
        level(k, "t", "q")
    return f"WITH {', '.join(parts)}\nSELECT doc_id, leaf, subroot, h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{tops} CROSS JOIN t{tops}"


ORACLE_SQL = _oracle()
