"""A Merkle tree over every group of a table, a tree over the groups' roots, and the proof of every row.

Every node carries the interval of leaf ranks that it covers. Nodes are kept by bands of four levels: one row holds a *bucket*,
the subtree below one node of the band's upper end, as an array of nodes for each level. A node's ancestors inside a
bucket are the nodes whose interval contains its own; the siblings at a level are what the parent's interval holds
beside the node's. Going up, a bucket's topmost node is a member of a bucket of the next band; coming down, a
bucket joins the one that contains it, by tree and bucket number, and takes over its proof. So each band is one grouping and one
join, however large a tree is; a bucket has at most 81 members, and a large group has many buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.llm import places

RUN = 3  # consecutive nodes that become one
LEVELS = 4  # levels of a band above its members
WIDTH = RUN**LEVELS
LEVEL_COLUMNS = [f"level{i}" for i in range(LEVELS + 1)]
STEP = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def record_digest(*fields: Column) -> Column:
    """SHA-256 of all fields, each with its length in bytes so that no two records are written alike; ``-`` for null."""
    written = [x.cast("string") for x in fields]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in written]
    return F.sha2(F.concat(*parts), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def _parents(nodes: Column) -> Column:
    """Runs of consecutive nodes as one node each, that covers what they cover."""

    def parent(i):
        run = F.slice(nodes, i * RUN + 1, RUN)
        return F.struct(
            F.get(run, F.lit(0))["lo"].alias("lo"),
            F.get(run, F.size(run) - 1)["hi"].alias("hi"),
            F.sha2(_joined(run), 256).alias("digest"),
        )

    runs = F.ceil(F.size(nodes) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), parent)


def _band(members: DataFrame) -> DataFrame:
    """Buckets of ``members`` (tree, size, place, lo, hi, digest), where ``size`` is the tree's number of members.

    A level is null in a tree that has come down to one node before.
    """
    bucket = F.floor(F.col("place") / WIDTH).cast("bigint")
    nodes = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
    rows = members.groupBy("tree", "size", bucket.alias("bucket")).agg(nodes.alias(LEVEL_COLUMNS[0]))
    for level, (below, here) in enumerate(zip(LEVEL_COLUMNS, LEVEL_COLUMNS[1:])):
        rows = rows.withColumn(here, F.when(F.col("size") > RUN**level, _parents(F.col(below))))
    return rows


def grow(members: DataFrame) -> list[DataFrame]:
    """The bands over ``members`` from below, kept in the shared folder."""
    bands = []
    while True:
        bands.append(shared.settle(_band(members), "merkle-band"))
        whole = bands[-1].where(F.col("size") > WIDTH)
        if whole.isEmpty():
            return bands
        size = F.ceil(F.col("size") / WIDTH).cast("bigint").alias("size")
        members = whole.select("tree", size, F.col("bucket").alias("place"), F.inline(LEVEL_COLUMNS[-1]))


def roots(bands: Sequence[DataFrame]) -> DataFrame:
    """``tree`` and the ``digest`` of its last node."""
    last = F.get(F.coalesce(*reversed(LEVEL_COLUMNS)), F.lit(0))["digest"]
    ended = [b.where(F.col("size") <= WIDTH).select("tree", last.alias("digest")) for b in bands]
    out = ended[0]
    for more in ended[1:]:
        out = out.union(more)
    return out


def nodes(bands: Sequence[DataFrame]) -> DataFrame:
    """The manifest: ``tree``, ``level``, ``lo``, ``hi`` (leaf ranks covered, ``hi`` exclusive) and ``digest`` of every node."""
    out = None
    for n, band in enumerate(bands):
        for i, name in enumerate(LEVEL_COLUMNS[:-1] if n + 1 < len(bands) else LEVEL_COLUMNS):
            # What tops a bucket is a member of the next band, unless its tree ends here.
            level = band.select("tree", F.lit(n * LEVELS + i).alias("level"), F.inline(name))
            out = level if out is None else out.unionByName(level)
        if n + 1 < len(bands):
            top = band.where(F.col("size") <= WIDTH).select("tree", F.lit((n + 1) * LEVELS).alias("level"), F.inline(LEVEL_COLUMNS[-1]))
            out = out.unionByName(top)
    return out


def _steps(at: Column, prefix: str) -> Column:
    """For each level of a bucket up to its last: the digests left and right of the node that covers ``at``."""

    def level(here: Column, above: Column) -> Column:
        def step(parent):
            left = F.filter(here, lambda x: (x["lo"] >= parent["lo"]) & (x["hi"] <= at))
            right = F.filter(here, lambda x: (x["lo"] > at) & (x["hi"] <= parent["hi"]))
            return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))

        ancestors = F.filter(above, lambda x: (x["lo"] <= at) & (at < x["hi"]))
        return F.coalesce(F.transform(ancestors, step), F.array().cast(STEP))

    columns = [F.col(prefix + name) for name in LEVEL_COLUMNS]
    return F.concat(*[level(here, above) for here, above in zip(columns, columns[1:])])


def attach(members: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """``members`` (tree, place, lo, ...) with their ``path`` to the root, and the columns ``carried`` by their bucket.

    The join takes each member to the one bucket whose interval contains it.
    """
    renamed = above.select([F.col(c).alias(f"_up_{c}") for c in above.columns])
    same = (F.col("tree") == F.col("_up_tree")) & (F.floor(F.col("place") / WIDTH) == F.col("_up_bucket"))
    path = F.concat(_steps(F.col("lo"), "_up_"), F.col("_up_path")).alias("path")
    return members.join(renamed, same).select(*members.columns, path, *[F.col(f"_up_{c}").alias(c) for c in carried])


def descend(bands: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest band with the ``path`` of each bucket; ``tops`` (tree, path, ...) says how a tree's root goes on."""
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for band in reversed(bands):
        here = band.where(F.col("size") <= WIDTH).join(tops, "tree").select(*band.columns, "path", *carried)
        if above is not None:
            lo = F.get(LEVEL_COLUMNS[0], F.lit(0))["lo"]
            inner = band.where(F.col("size") > WIDTH).withColumns({"place": F.col("bucket"), "lo": lo})
            here = here.unionByName(attach(inner, above, *carried).drop("place", "lo"))
        above = shared.settle(here, "merkle-paths")
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def _as_members(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"lo": F.col("place"), "hi": F.col("place") + 1})


class Manifest:
    """The trees over ``docs``: ``leaves``, ``bands`` of the groups' trees, ``tops`` over their roots.

    A null group is a group of its own, before all others. Rows of a group are ordered by id, nulls first, and by digest
    where ids are equal; of equal rows each has a leaf. An empty table has no leaf and no root. Columns besides
    ``fields`` are neither read nor looked at; ``keep`` are passed on with the leaves.
    """

    def __init__(self, docs: DataFrame, fields: Sequence[str] = FIELDS, id_column: str = "doc_id", group: str = "source", keep: dict | None = None):
        tree = places.key_of(F.col(group))
        own = [c.alias(n) for n, c in (keep or {}).items()]
        rows = docs.select(F.col(id_column).alias("id"), tree.alias("tree"), record_digest(*map(F.col, fields)).alias("digest"), *own)
        leaves = places.numbered(rows, "tree", [F.asc_nulls_first("id"), F.asc("digest")], "merkle-leaves")
        self.leaves = shared.settle(_as_members(leaves), "merkle-leaves")
        self.bands = grow(self.leaves)
        by_name = roots(self.bands).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
        self.groups = shared.settle(_as_members(places.numbered(by_name, "tree", [F.asc("group")], "merkle-groups")), "merkle-groups")
        self.tops = grow(self.groups)

    def proofs(self) -> DataFrame:
        """The leaves with their ``path``, ``subroot`` (of their group) and ``root``."""
        root = roots(self.tops).select("tree", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
        groups = attach(self.groups, descend(self.tops, root), "root")
        groups = groups.select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
        return attach(self.leaves, descend(self.bands, shared.settle(groups, "merkle-groups")), "subroot", "root")


def verify(docs: DataFrame, received: Column, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Check every row as received, its text being ``received``, against the manifest of the rows of ``docs``.

    Per row: the id, ``leaf``, ``subroot``, ``root`` and ``proof_sha256`` (of its siblings' digests) of the original, the root
    that the received row folds to, and whether that is the root. ``Manifest`` says what nulls and repeated rows do.
    """
    fields = [received if c == text else F.col(c) for c in FIELDS]
    proofs = Manifest(docs, id_column=id_column, keep={"arrived": record_digest(*fields)}).proofs()
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = proofs.select(
        F.col("id").alias(id_column),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("arrived"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_feeds(text: str = "text", id_column: str = "doc_id") -> Column:
    """The text as received where a row's id has an even CRC-32: without line feeds. Other rows' texts, and nulls, arrive whole."""
    hit = F.crc32(F.col(id_column).cast("string")) % 2 == 0
    return F.when(hit, F.translate(text, "\n", "")).otherwise(F.col(text))
