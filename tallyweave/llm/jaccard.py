"""N-gram Jaccard join by grouped prefixes, and the classes its links make.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold.  The join is
exact.  Its steps, each sized by the input and none bound to one task:

1. Blocks of documents are hashed into shingle sets, equal sets of a block collapse, and what is left is
   dealt out by hash range, packed as arrays; a shingle that several sets of a block hold goes out once.
   Each range counts its shingles' sets and sends back only those held by two or more.
   A document whose repeated shingles are too few to reach the threshold can link with nothing.
2. Documents of equal sets collapse into one.  Shingles are ordered from rare to common; the prefix of
   an n-set is its first n - ceil(t n) + 1.  Documents of identical prefix and size form a group.
3. Groups that share a prefix shingle and pass the size and position bounds are candidates.  The groups
   of a shingle that very many share hang, by runs of sizes, on one of them instead of being paired.
   What candidates connect is a cluster, and every link lies within one.
4. Clusters are expanded to members and verified: small ones in one piece, larger ones in tiles of
   bounded rows.  A piece counts overlaps exactly and returns members with their smallest, not pairs.
5. Classes are the connected components of those links, carried back to equal sets.

Shingles are told apart by 64-bit hashes, sets by 128-bit digests; a block is a task's run of rows, numbered
by the task for this one shuffle only, and no number leaves it.

Contract for odd input: null or empty texts and texts without words have no shingles and link with
nothing; fewer words than a shingle make one shingle; rows without an id are left out and
are not returned; rows that repeat an id are returned as often, and links go by id, so rows of one id
with different texts share their class, while a row without shingles has its id for a class;
other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import give_back, materialize, pieces, small_batches, table
from tallyweave.llm.components import connected, forest

#: Documents and characters of a block; a block's documents are numbered by 16 bits.
BLOCK_DOCS, BLOCK_CHARS = 60_000, 6_000_000
CACHE_WORDS = 200_000
#: Prefix shingles held by more groups than this chain them.
CHAIN_FROM = 48
#: Documents of a tile of a large cluster.
TILE = 768
#: Holders of a shingle beyond this are told apart by hash alone; they only order shingles.
MOST_HELD = 65_535
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Shingler:
    """64-bit hashes of a text's distinct shingles."""

    def __init__(self, k: int) -> None:
        self.k, self.known = k, {}

    def words(self, text: str) -> np.ndarray:
        known = self.known
        found = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII alone
        try:
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def shingles(self, text: str | None) -> np.ndarray:
        h = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(h):
            return h
        # fewer words: the whole sequence, told apart from longer ones by its length
        k = min(self.k, len(h))
        n = len(h) - k + 1
        s = np.full(n, _MIX[2] >> np.uint64(k))
        for i in range(k):
            s = (s ^ (s >> np.uint64(29))) * _MIX[1] + h[i : i + n]
        s = (s ^ (s >> np.uint64(32))) * _MIX[0]
        s ^= s >> np.uint64(29)
        return np.unique(s)


def least_overlap(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The fewest shingles an n-set must share with a set it links with."""
    return -(-percent * n // 100)


# --- 1. shingle sets, packed and dealt by hash range ---------------------------------------------------

#: Kinds of packed rows: a block's documents; shingles with the set that holds them; shingles that MANY sets of
#: the block or more hold, once with their count; and, kept beside the block, who holds the latter.
ABOUT, SINGLE, SEVERAL, HOLDERS = range(4)
#: From here on a count and a list of holders are fewer bytes than an entry for each holder.
MANY = 4


def _squeezed(numbers: np.ndarray, rising: bool) -> bytes:
    """16-bit numbers in few bytes: steps of ``rising`` ones, low bytes before high ones, deflated."""
    n = numbers.astype("<u2")
    if rising:
        n = np.diff(n, prepend=n.dtype.type(0))  # steps wrap, so any numbers come back
    return zlib.compress(n.view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def _loosened(cells: pd.Series, rising: bool) -> np.ndarray:
    """The numbers of :func:`_squeezed` cells, one after the other."""
    out = [np.zeros(0, "<u2")]
    for cell in cells:
        n = np.frombuffer(zlib.decompress(cell), np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
        out.append(np.cumsum(n, dtype=np.uint16) if rising else n)
    return np.concatenate(out)


def _pack(docs: DataFrame, k: int, shards: int) -> DataFrame:
    """Rows ``shard, top, block, kind, hashes, owner, sizes``; ``top`` is the first byte of a row's hashes, which hold the rest.

    Equal sets of a block are dealt out once, and so is a shingle that several sets of the block hold: what
    a hot text or shingle sends to its shard grows with the blocks and not with the documents.
    """

    def flush(ids: list, sets: list[np.ndarray], block: int) -> Iterator[dict]:
        def row(kind: int, shard: int, hashes: bytes, owner: bytes, sizes: bytes, top: int = 0) -> dict:
            return {"shard": shard, "top": top, "block": block, "kind": kind, "hashes": hashes, "owner": owner, "sizes": sizes}

        here = -1 - block % shards
        digests = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
        yield row(ABOUT, here, b"".join(digests), np.array(ids, "<i8").tobytes(), np.array([len(s) for s in sets], "<u4").tobytes())
        first: dict[bytes, int] = {}
        for i, d in enumerate(digests):
            first.setdefault(d, i)
        dealt = sorted(first.values())
        flat = np.concatenate([sets[i] for i in dealt])
        owner = np.repeat(np.array(dealt, "<u2"), [len(sets[i]) for i in dealt])
        by = np.argsort(flat, kind="stable")
        asc = flat[by]
        new = np.flatnonzero(np.concatenate([[True], asc[1:] != asc[:-1]])) if len(asc) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(asc)))
        lone_asc = np.repeat(count < MANY, count)
        many, many_count = asc[new[count >= MANY]], count[count >= MANY].astype("<u2")
        if len(many):
            yield row(HOLDERS, here, many.astype("<u8").tobytes(), _squeezed(owner[by][~lone_asc], True), _squeezed(many_count, False))
        lone = np.empty(len(flat), bool)
        lone[by] = lone_asc
        for kind, part, side in ((SINGLE, flat[lone], owner[lone]), (SEVERAL, many, many_count)):
            # The shard is the hash's place in as many equal ranges.  Shard and first byte rise with the hash, so
            # their sum tells both; a row's holders stay in order, as small steps are few bytes.
            shard, top = ((part >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24), part >> np.uint64(56)
            place = (shard + top).astype(np.uint16 if shards < 65_000 else np.uint32)
            order = np.argsort(place, kind="stable")
            part, side, place = part[order], side[order], place[order]
            low = part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
            cut = (np.flatnonzero(place[1:] != place[:-1]) + 1).tolist()
            for at, end in zip([0, *cut], [*cut, len(part)], strict=True):
                if at < end:
                    mine, h = side[at:end], int(part[at])
                    yield row(kind, (h >> 40) * shards >> 24, low[at:end].tobytes(), _squeezed(mine, True) if kind == SINGLE else b"", _squeezed(mine, False) if kind == SEVERAL else b"", h >> 56)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        task = TaskContext.get().partitionId()
        ids, sets, chars, count = [], [], 0, 0
        for batch in batches:
            for i, t in zip(batch["id"].tolist(), batch["text"], strict=True):
                ids.append(i)
                sets.append(shingler.shingles(t if isinstance(t, str) else None))
                chars += len(t) if isinstance(t, str) else 0
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield pd.DataFrame(flush(ids, sets, task << 24 | count))
                    ids, sets, chars, count = [], [], 0, count + 1
        if ids:
            yield pd.DataFrame(flush(ids, sets, task << 24 | count))
        del shingler, ids, sets
        give_back()

    return small_batches(docs).mapInPandas(run, "shard int, top int, block bigint, kind int, hashes binary, owner binary, sizes binary")


def _joined(cells: pd.Series, kind: str | type) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind)


def _full(rows: pd.DataFrame) -> np.ndarray:
    """The hashes of rows that hold seven bytes of each beside the row's ``top``."""
    counts = rows["hashes"].map(len).to_numpy(np.int64) // 7
    whole = np.zeros((counts.sum(), 8), np.uint8)
    whole[:, :7] = _joined(rows["hashes"], np.uint8).reshape(-1, 7)
    whole[:, 7] = np.repeat(rows["top"].to_numpy(np.int64), counts)
    return whole.view("<u8").ravel()


def _repeated(packed: DataFrame) -> DataFrame:
    """Per shard, the entries whose shingle two or more sets hold: ``block, kind, top, hashes, owner, held``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["block", "kind", "top", "hashes", "owner", "held"]
        if key[0] < 0:  # what blocks tell of their documents passes through
            return rows.rename(columns={"sizes": "held"})[names]
        counts = rows["hashes"].map(len).to_numpy() // 7
        h = _full(rows)
        low = h.view(np.uint8).reshape(-1, 8)
        weight = np.concatenate([_loosened([s], False) if kind == SEVERAL else np.ones(n, np.uint16) for kind, n, s in zip(rows["kind"], counts, rows["sizes"], strict=True)])
        by = np.argsort(h)
        new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
        run_of = np.cumsum(new) - 1
        held = np.empty(len(h), np.int64)
        held[by] = np.add.reduceat(weight[by].astype(np.int64), np.flatnonzero(new))[run_of]
        out, at = [], 0
        for block, kind, top, n, o in zip(rows["block"], rows["kind"], rows["top"], counts.tolist(), rows["owner"], strict=True):
            here = slice(at, at + n)
            at += n
            keep = held[here] >= 2
            if keep.any():
                owner = _squeezed(_loosened([o], True)[keep], True) if kind == SINGLE else b""
                out.append((block, kind, top, low[here, :7][keep].tobytes(), owner, _squeezed(np.minimum(held[here][keep], MOST_HELD), False)))
        return pd.DataFrame(out, columns=names)

    return packed.groupBy("shard").applyInPandas(run, "block bigint, kind int, top int, hashes binary, owner binary, held binary")


def _sets(repeated: DataFrame, percent: int) -> DataFrame:
    """Per document ``id, n, digest`` and ``shared``: its repeated shingles, rare first.

    ``shared`` is null where too few shingles are repeated to link, and for sets equal to one before them in the block.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        def of(kind: int) -> pd.DataFrame:
            return rows[rows["kind"] == kind]

        about = of(ABOUT).iloc[0]
        ids, sizes = np.frombuffer(about["owner"], "<i8"), np.frombuffer(about["held"], "<u4").astype(np.int64)
        single, several, holders = of(SINGLE), of(SEVERAL), of(HOLDERS)
        h, owner, held = _full(single), _loosened(single["owner"], True), _loosened(single["held"], False)
        if len(holders):
            known, known_held = _full(several), _loosened(several["held"], False)
            by = np.argsort(known)
            mine, count = _joined(holders["hashes"], "<u8"), _loosened(holders["held"], False)
            at = by[np.searchsorted(known, mine, sorter=by)]
            h, owner = np.concatenate([h, np.repeat(mine, count)]), np.concatenate([owner, _loosened(holders["owner"], True)])
            held = np.concatenate([held, np.repeat(known_held[at], count)])
        owner = owner.astype(np.int64)
        have = np.bincount(owner, minlength=len(ids))
        can = (sizes > 0) & (have >= least_overlap(sizes, percent))
        keep = can[owner]
        h, owner, held = h[keep], owner[keep], held[keep]
        by = np.lexsort((h, held, owner))
        h = h[by].astype("<u8").tobytes()
        edge = np.concatenate([[0], np.cumsum(np.where(can, have, 0))]) * 8
        digest = [about["hashes"][16 * i : 16 * i + 16] if n else b"" for i, n in enumerate(sizes)]
        shared = [h[edge[i] : edge[i + 1]] if c else None for i, c in enumerate(can)]
        return pd.DataFrame({"id": ids, "n": sizes, "digest": digest, "shared": shared})

    return repeated.groupBy("block").applyInPandas(run, "id bigint, n bigint, digest binary, shared binary")


# --- 2. groups of identical prefix and size ------------------------------------------------------------


def _prefixes(reps: DataFrame, percent: int) -> DataFrame:
    """``id, n, sig, prefix, first``: the repeated part of each prefix and the place of its first shingle.

    Shingles that one document alone holds come first in the order and can meet nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, n, shared in zip(batch["id"], batch["n"], batch["shared"], strict=True):
                alone = n - len(shared) // 8
                cut = shared[: 8 * max(0, n - least_overlap(n, percent) + 1 - alone)]
                sig = xxhash.xxh64_intdigest(cut) - (1 << 63) if alone == 0 else xxhash.xxh64_intdigest(str(i)) - (1 << 63)
                out.append((i, n, sig, alone == 0, np.frombuffer(cut, "<i8").tolist(), alone))
            yield pd.DataFrame(out, columns=["id", "n", "sig", "whole", "prefix", "first"])

    return reps.select("id", "n", "shared").mapInPandas(run, "id bigint, n bigint, sig bigint, whole boolean, prefix array<bigint>, first bigint")


# --- 3. candidates -------------------------------------------------------------------------------------


def _candidates(groups: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` between groups that share a prefix shingle and may link; stars for common shingles."""
    postings = groups.select("gid", "n", F.posexplode("prefix").alias("k", "shingle"), "first").select("shingle", "gid", "n", (F.col("first") + F.col("k")).alias("place"))
    common = postings.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1")
    met = postings.join(common, "shingle")
    few = met.where(F.col("m") <= CHAIN_FROM).groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("n", "gid", "place"))).alias("g"))
    pairs = few.select(F.posexplode("g").alias("i", "x"), "g").select("x", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("y"))
    nx, ny, px, py = (F.col(c) for c in ("x.n", "y.n", "x.place", "y.place"))
    need = F.ceil(percent * (nx + ny) / (100 + percent) - 1e-9)
    pairs = pairs.where((100 * nx >= percent * ny) & (1 + F.least(px, py) + F.least(nx - px, ny - py) - 1 >= need))
    pairs = pairs.select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"))
    # A common shingle: its groups fall into runs of sizes that may all link, and each hangs on the smallest
    # of its run.  Runs whose ends may link are bridged.  Smallest and ends are summed per task first, so no
    # task sorts one shingle's groups; the join that hands the smallest back is split by AQE.
    many = met.where(F.col("m") > CHAIN_FROM).withColumn("run", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.01 / percent))))
    runs = many.groupBy("shingle", "run").agg(F.min("gid").alias("head"), F.min("n").alias("low"), F.max("n").alias("high"))
    # A shingle's few runs go back to its groups as one map, where the groups are.
    heads = runs.groupBy("shingle").agg(F.map_from_entries(F.collect_list(F.struct("run", "head"))).alias("heads"))
    hung = many.join(heads, "shingle").select(F.col("heads")[F.col("run")].alias("a"), F.col("gid").alias("b"))
    across = Window.partitionBy("shingle").orderBy("run")  # a shingle has as many runs as sizes have powers
    bridge = runs.withColumn("prior", F.lag(F.struct("run", "head", "high")).over(across)).where((F.col("prior.run") == F.col("run") - 1) & (100 * F.col("prior.high") >= percent * F.col("low")))
    return pairs.unionByName(hung).unionByName(bridge.select(F.col("prior.head").alias("a"), F.col("head").alias("b"))).where("a <> b").distinct()


# --- 4. verification -----------------------------------------------------------------------------------


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right`` (None: with ``left``)."""
    other = left if right is None else right
    a = np.concatenate(left)
    b = a if right is None else np.concatenate(right)
    rows_a, rows_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, other))
    # number the shingles that both sides hold
    both = np.intersect1d(a, b) if right is not None else np.unique(a)
    na, nb = np.searchsorted(both, a), np.searchsorted(both, b)
    na[na == len(both)] = 0
    nb[nb == len(both)] = 0
    ina, inb = both[na] == a if len(both) else np.zeros(len(a), bool), both[nb] == b if len(both) else np.zeros(len(b), bool)
    na, rows_a, nb, rows_b = na[ina], rows_a[ina], nb[inb], rows_b[inb]
    out = np.zeros((len(left), len(other)), np.float32)
    if not len(both):
        return out.astype(np.int64)
    ka, kb = np.bincount(na, minlength=len(both)), np.bincount(nb, minlength=len(both))
    # Shingles held by many: a product of 0/1 matrices, some columns at a time.
    heavy = (ka * kb) > 64
    rank = np.cumsum(heavy) - 1
    width = 4096
    ha, hb = heavy[na], heavy[nb]
    ca, ra, cb, rb = rank[na[ha]], rows_a[ha], rank[nb[hb]], rows_b[hb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    for lo in range(0, int(heavy.sum()), width):
        ia, ib = slice(*np.searchsorted(ca, [lo, lo + width])), slice(*np.searchsorted(cb, [lo, lo + width]))
        ma, mb = np.zeros((len(left), width), np.float32), np.zeros((len(other), width), np.float32)
        ma[ra[ia], ca[ia] - lo] = 1
        mb[rb[ib], cb[ib] - lo] = 1
        out += ma @ mb.T
    # The others: each one's few pairs, written out.
    la, lb = ~ha, ~hb
    na, rows_a, nb, rows_b = na[la], rows_a[la], nb[lb], rows_b[lb]
    ob = np.argsort(nb, kind="stable")
    nb, rows_b = nb[ob], rows_b[ob]
    start, stop = np.searchsorted(nb, na, "left"), np.searchsorted(nb, na, "right")
    reps = stop - start
    if reps.sum():
        i = np.repeat(rows_a, reps)
        j = rows_b[np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start, reps)]
        out += np.bincount(i * len(other) + j, minlength=out.size).reshape(out.shape)
    return np.rint(out).astype(np.int64)


def _verify(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (cluster, id, n, shared) to ``a, b, links, whole``.

    Each linked member has a row with the smallest id ``b`` of those it is connected with in the piece, itself
    included, and its number of links there.  ``whole`` tells that the piece is its whole cluster, so ``b`` is
    final; else the pieces' rows are edges to be connected.
    """
    order = Window.partitionBy("cluster")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    rows = members.join(sizes, "cluster").where("m > 1")
    small = rows.where(F.col("m") <= 2 * TILE).withColumn("piece", F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
    small = small.withColumn("tile", F.lit(0)).withColumn("whole", F.lit(True))
    # Large clusters: tiles of neighbouring sizes; a tile meets those whose sizes may link.
    large = rows.where(F.col("m") > 2 * TILE)
    ranked = large.withColumn("tile", F.floor((F.row_number().over(order.orderBy("n", "id")) - 1) / TILE).cast("int"))
    tiles = ranked.groupBy("cluster", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = tiles.select(F.col("cluster").alias("c2"), F.col("tile").alias("t2"), F.col("low").alias("low2"))
    meets = tiles.join(other, (F.col("cluster") == F.col("c2")) & (F.col("t2") >= F.col("tile")) & (100 * F.col("high") >= percent * F.col("low2")))
    meets = meets.select("cluster", F.col("tile").alias("x"), F.col("t2").alias("y"))
    ends = meets.select("cluster", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"), F.struct("x", "y").alias("p")).groupBy("cluster", "tile").agg(F.collect_list("p").alias("piece"))
    large = ranked.join(ends, ["cluster", "tile"]).withColumn("whole", F.lit(False)).select(*small.columns)
    dealt = small.unionByName(large).select("cluster", "id", "n", "shared", "tile", "whole", F.explode("piece").alias("p")).select("cluster", "id", "n", "shared", "tile", "whole", "p.x", "p.y")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile", "n", "id"])
        x, y = rows["x"].iloc[0], rows["y"].iloc[0]

        def side(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            return part["id"].to_numpy(), part["n"].to_numpy(), [np.frombuffer(s, "<u8") for s in part["shared"]]

        ids, n, sets = side(rows[rows["tile"] == x])
        if x == y:
            ids2, n2 = ids, n
            both = overlaps(sets, None)
        else:
            ids2, n2, sets2 = side(rows[rows["tile"] == y])
            both = overlaps(sets, sets2)
        links = 100 * both >= percent * (n[:, None] + n2[None, :] - both)
        if x == y:
            np.fill_diagonal(links, False)
        i, j = np.nonzero(links)
        root = forest(zip(ids[i].tolist(), ids2[j].tolist(), strict=True))
        count = dict(zip(ids.tolist(), links.sum(1).tolist(), strict=True))
        if x != y:
            count |= dict(zip(ids2.tolist(), links.sum(0).tolist(), strict=True))
        out = [(a, b, count[a], bool(rows["whole"].iloc[0])) for a, b in root.items()]
        return pd.DataFrame(out, columns=["a", "b", "links", "whole"])

    return dealt.groupBy("cluster", "x", "y").applyInPandas(run, "a bigint, b bigint, links bigint, whole boolean")


# --- 5. classes ----------------------------------------------------------------------------------------


def classes(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, set_id, set_links`` for every row with an id.

    ``set_id`` is the smallest id with an equal set, ``set_links`` the number of other sets it links with.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    shards = pieces(rows, 4 << 20, least=4)
    sets = materialize(_sets(_repeated(_pack(rows, k, shards)), percent))
    # Equal sets collapse; sums of small columns, so a text copied a million times is one row a task.  A set's
    # node is the smallest id that carries its shingles; its name is the smallest id that has it.
    carrier = F.min(F.when(F.col("shared").isNotNull(), F.col("id")))
    equal = sets.where("n > 0").groupBy("n", "digest").agg(F.min("id").alias("set_id"), carrier.alias("carrier")).withColumn("node", F.coalesce("carrier", "set_id"))
    reps = sets.where("shared IS NOT NULL").join(equal.select(F.col("carrier").alias("id")), "id", "left_semi").dropDuplicates(["id", "digest"]).select("id", "n", "shared")
    prefixes = materialize(_prefixes(reps, percent))
    groups = prefixes.groupBy("n", "sig", "whole").agg(F.min("id").alias("gid"))
    grouped = prefixes.join(groups, ["n", "sig", "whole"]).select("id", "n", "prefix", "first", "gid")
    edges = _candidates(grouped.where("id = gid").dropDuplicates(["gid", "n"]), percent)
    clusters = connected(edges)
    member = grouped.select("id", "gid").distinct().join(clusters.withColumnRenamed("node", "gid"), "gid", "left").select("id", F.coalesce("root", "gid").alias("cluster"))
    verified = materialize(_verify(reps.join(member, "id").select("cluster", "id", "n", "shared"), percent))
    # Clusters of one piece are settled: their rows name the root.  Pieces of large clusters are connected, and
    # so are the sets of rows that share an id and have different texts, by way of the roots they have.
    near = verified.where("whole").select(F.col("a").alias("node"), F.col("b").alias("near"))

    def lifted(df: DataFrame, col: str) -> DataFrame:
        return df.join(near.withColumnRenamed("node", col), col, "left").withColumn(col, F.coalesce("near", col)).drop("near")

    same_id = sets.where("n > 0").groupBy("id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select("id")
    through = sets.join(same_id, "id", "left_semi").where("n > 0").join(equal, ["n", "digest"]).select(F.col("id").alias("a"), F.col("node").alias("b")).where("a <> b")
    far = connected(verified.where(~F.col("whole")).select("a", "b").unionByName(lifted(lifted(through, "a"), "b")))
    links = verified.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("set_links"))
    known = equal.select("n", "digest", "set_id", "node").join(near, "node", "left").withColumn("near", F.coalesce("near", "node")).join(links, "node", "left")
    known = materialize(known.join(far.withColumnRenamed("node", "near"), "near", "left").withColumn("root", F.coalesce("root", "near")))
    least = known.groupBy("root").agg(F.min("set_id").alias("component"))
    known = known.join(least, "root").select(F.col("n").alias("kn"), F.col("digest").alias("kd"), "set_id", "component", "set_links")
    out = sets.select("id", "n", "digest").join(known, (F.col("n") == F.col("kn")) & (F.col("digest") == F.col("kd")), "left")
    return out.select(
        "id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce("set_id", "id").alias("set_id"),
        F.coalesce("set_links", F.lit(0).cast("long")).alias("set_links"),
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each class the smallest id stays, and rows without an id.

    Rows that repeat an id are one document: they all stay, or all go if each of them belongs to another's class.
    """
    found = classes(docs, k, percent, id_col, text_col)
    gone = found.groupBy("id").agg(F.max("component_id").alias("c")).where("c <> id").select(F.col("id").alias("gone_id"))
    return docs.join(gone, F.col(id_col) == F.col("gone_id"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM cut
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (SELECT g FROM sets GROUP BY g HAVING count(*) > 1
), held AS (SELECT s.doc_id, s.g FROM sets s JOIN shared USING (g)
), able AS (SELECT h.doc_id, any_value(n) AS n FROM held h JOIN sizes USING (doc_id) GROUP BY h.doc_id HAVING 100 * count(*) >= 85 * any_value(n)
), kept AS (SELECT h.doc_id, h.g, a.n FROM held h JOIN able a USING (doc_id)
), met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (SELECT a, b FROM met WHERE 100 * k >= 85 * (na + nb - k)
), reach(a, b) AS (SELECT doc_id, doc_id FROM able UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""
