"""Near-duplicate groups by order MinHash and banded alignment.

Documents are sequences of five-word shingles.  Each shingle is labelled by its
occurrence number, and each of some hash orders samples the ``SAMPLED`` least
(``SHORT_SAMPLED`` in short texts) labelled shingles and keeps them in text order, so that two texts share a
sketch only if they agree on what is sampled and on its order.

Texts with equal words are one node.  Nodes that share a sketch are candidates;
a candidate pair is a link if an alignment of the two shingle sequences, inside
the band that the threshold allows, matches m of a + b - m with a share of at
least ``SIMILARITY``.  First every node is compared with the least node of each
of its buckets, so a bucket of n equal-looking texts costs n comparisons.  In
``HUB_ROUNDS`` further rounds the node with most links so far stands in for it
where a bucket is still split, which joins the copies of one text that are less
alike among themselves.  At last the nodes of buckets that are still split are
compared with each other wherever a link between groups is possible at all
(``prefix_pairs``), so no link among them is lost however full a bucket is.  A pair
at the threshold with distinct shingles shares no sketch, and so is no candidate,
with a chance of 4e-5 at most (18 and 18 shingles; 4 and 5 in short texts), and
less the longer or the more alike the texts are.  Groups are the connected
components.

Edge cases: null and empty texts have no words, and each is a group of its own;
texts of one to four words have one shingle and group only with equal words;
case of ASCII letters and characters between words don't count; rows of equal
id and text are one node and share its group; null ids come first; an empty
table gives an empty result; extra columns are kept, and columns named as a result
are replaced by ``with_groups`` and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import field, named, packed, release, ship_package, unpacked, whole_text, written
from tidemark.llm.decontaminate import normal_words

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches of a text, and labelled shingles in each.
SKETCHES, SAMPLED = 64, 7
#: The same for short texts, where few shingles must do; ``SHORT`` gives the shingles
#: up to which a text has short sketches and from which on it has long ones.  Lengths
#: of a pair within the threshold fall on the same side of at least one of them.
SHORT_SKETCHES, SHORT_SAMPLED = 20, 3
SHORT = (15, 12)
HUB_ROUNDS = 2

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = np.random.default_rng(20240229).integers(1, 2**63, SKETCHES + SHORT_SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled_shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the shingles, each labelled by its occurrence number."""
    w = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h ^ (h >> np.uint64(32))) * _MIX + w[k : k + n]
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if same.any():
        at = np.arange(n)
        since = at - np.maximum.accumulate(np.where(same, 0, at))
        h[order] += since.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def sampled_values(h: np.ndarray, orders: np.ndarray, size: int) -> list[int]:
    """One signed 64-bit value for each hash order: the least shingles in text order."""
    if len(h) > size:
        picked = h[np.sort(np.argpartition(h[None, :] * orders[:, None], size, axis=1)[:, :size], axis=1)]
    else:
        picked = np.tile(h, (len(orders), 1))
    value = np.zeros(len(orders), dtype=np.uint64)
    for column in picked.T:
        value = (value ^ (value >> np.uint64(31))) * _MIX + column
    return value.view(np.int64).tolist()


def order_sketches(words: list[bytes]) -> list[int | None]:
    """The values of the long, then of the short sketches; null where a text has none of a kind."""
    if len(words) < SHINGLE:
        return []
    h = labelled_shingles(words)
    long = sampled_values(h, _ORDERS[:SKETCHES], SAMPLED) if len(h) >= SHORT[1] else [None] * SKETCHES
    return long + sampled_values(h, _ORDERS[SKETCHES:], SHORT_SAMPLED) if len(h) <= SHORT[0] else long


def shingle_list(words: list[bytes]) -> list[tuple[bytes, ...]]:
    if len(words) < SHINGLE:
        return [tuple(words)] if words else []
    return list(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def banded_matches(a: list, b: list, band: int) -> int:
    """Longest common subsequence whose matches stay within ``band`` of the diagonal.

    The row of the alignment table is a bit vector of which only the band is
    kept; a zero bit that leaves it is a matched step.
    """
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    width = 2 * band + 1
    mask = (1 << width) - 1
    row, low, passed = mask, -band, 0
    for j, x in enumerate(b):
        if j:
            passed += 1 - (row & 1)
            row = (row >> 1) | (1 << (width - 1))
            low += 1
        found = 0
        for i in places.get(x, ()):
            if 0 <= i - low < width:
                found |= 1 << (i - low)
        if found:
            row = ((row + (row & found)) | (row & ~found)) & mask
    return lead + tail + passed + width - row.bit_count()


def similarity(a: list, b: list, least: float = SIMILARITY) -> float:
    """Matched shingles over all shingles of an alignment; 0 as soon as it must be under ``least``."""
    total = len(a) + len(b)
    if not a or not b:
        return 0.0
    need = math.ceil(least * total / (1 + least) - 1e-9)
    if min(len(a), len(b)) < need:
        return 0.0
    count = Counter(a)
    if sum(min(n, count[x]) for x, n in Counter(b).items() if x in count) < need:
        return 0.0
    m = banded_matches(a, b, total - 2 * need)
    return m / (total - m)


def sketch_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (id, version, n, digest, sketch): one for each row of ``docs``."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("n int, digest binary, sketch array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = normal_words(t)
            digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
            rows.append((max(len(words) - SHINGLE + 1, min(len(words), 1)), digest, order_sketches(words)))
        return pd.DataFrame(rows, columns=["n", "digest", "sketch"])

    found = docs.select(named(doc_id).alias("id"), F.xxhash64(whole_text(text)).alias("version"), sketched(named(text)).alias("s"))
    return found.select("id", "version", "s.n", "s.digest", "s.sketch")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the least node that each node of ``edges`` (a, b) is connected to.

    Labels spread along edges and then jump to their label's label, so rounds
    grow with the logarithm of a component's width; each round is written.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        roots = labels.select(F.col("node").alias("via"), F.col("root").alias("onward"))
        jumped = written(spread.join(roots, F.col("root") == F.col("via"), "left").select("node", "old", F.least("root", F.coalesce("onward", "root")).alias("root")))
        before, labels = labels, jumped.select("node", "root")
        labels._tidemark_path = jumped._tidemark_path
        release(before)
        if jumped.where("root <> old").isEmpty():
            release(both)
            return labels


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The links among candidate ``pairs`` (a, b); ``texts`` has (node, body)."""

    @F.pandas_udf("double")
    def aligned(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, own = [], None, []
        for a, b in zip(left, right, strict=True):
            if a is not last:
                own, last = shingle_list(normal_words(a)), a
            out.append(similarity(own, shingle_list(normal_words(b)), least))
        return pd.Series(out, dtype="float64")

    one = texts.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    two = texts.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    met = pairs.join(one, "a").join(two, "b")
    return met.where(aligned("body_a", "body_b") >= least).select("a", "b")


def shingle_rows(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (node, n, root, token): the labelled shingles of ``nodes`` (node, n, root)."""

    @F.pandas_udf("array<long>")
    def tokens(bodies: pd.Series) -> pd.Series:
        return pd.Series([labelled_shingles(normal_words(b)).view(np.int64).tolist() for b in bodies], dtype=object)

    return nodes.join(texts, "node").select("node", "n", "root", F.explode(tokens("body")).alias("token"))


def prefix_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y) of nodes in different groups that may reach ``least``; no such pair is left out.

    ``rows`` has (node, n, root, token).  A similarity of ``least`` asks for a share
    of common tokens.  In any one order of tokens, the first common token then
    stands near the front of both, so only these prefixes are joined.  Tokens of
    one group alone can't be common to two and come first, then rare ones before
    frequent ones, so a passage that many texts hold is in the prefix only of
    texts that are almost nothing else.  The shorter text of a pair needs the
    shorter prefix.  Rows of a token's largest group meet only those of its other
    groups, so copies of one text aren't paired among themselves.
    """
    both = 2 * least / (1 + least)  # of the shorter one's tokens, those that must be common
    rows = written(rows)
    spread = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token", "df")
    place = Window.partitionBy("node").orderBy("df", "token")
    shared = rows.join(spread, "token").withColumns({"at": F.row_number().over(place), "k": F.count("*").over(Window.partitionBy("node"))})
    prefix = shared.withColumn("pos", F.col("n") - F.col("k") + F.col("at")).where(f"pos <= n - ceil({least} * n - 1e-9) + 1")
    prefix = prefix.select("token", "node", "n", "root", "pos")
    main = prefix.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    prefix = written(prefix.join(main, "token").withColumn("in_main", F.col("root") == F.col("main")).drop("main"))
    release(rows)

    short = prefix.where(f"pos <= n - ceil({both} * n - 1e-9) + 1").select("token", F.col("node").alias("x"), F.col("n").alias("a"), F.col("root").alias("rx"), F.col("pos").alias("i"), F.col("in_main").alias("mx"))
    long = prefix.select("token", F.col("node").alias("y"), F.col("n").alias("b"), F.col("root").alias("ry"), F.col("pos").alias("j"), F.col("in_main").alias("my"))
    fits = f"rx <> ry and (a < b or a = b and x < y) and a >= {least} * b - 1e-9 and least(a - i, b - j) + 1 >= {both / 2} * (a + b) - 1e-9"
    # (a = b and x > y is met with the roles changed: both prefixes of equal lengths hold the first common token.)
    pairs = [left.join(right, "token").where(fits).select("x", "y") for left, right in ((short.where("not mx"), long), (short.where("mx"), long.where("not my")))]
    return pairs[0].unionByName(pairs[1]).distinct()


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Rows (id, version, copies, group_id, group_version): one for each distinct row of ``docs``.

    ``version`` is ``xxhash64`` of the text, so (id, version) joins back to
    ``docs``; the group is named by its least (id, version).
    """
    sketched = written(sketch_documents(docs, doc_id, text))
    rows = sketched.groupBy("id", "version", "digest").agg(F.count("*").alias("copies"))
    words = sketched.where("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "version")).alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(words)
    bands = nodes.select("node", "n", F.posexplode("sketch").alias("band", "value")).where("value is not null")
    heads = bands.groupBy("band", "value").agg(F.min("node").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = written(bands.join(heads, ["band", "value"]))
    reach = f"least(n, m) >= {least} * greatest(n, m)"
    sizes = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"))
    tested = written(shared.where("a <> node").select("a", F.col("node").alias("b"), "n").distinct().join(sizes, "a").where(reach).select("a", "b"))

    key = docs.select(F.struct(named(doc_id).alias("id"), F.xxhash64(whole_text(text)).alias("version")).alias("node"), named(text).alias("body"))
    wanted = shared.select("node").distinct()
    texts = written(key.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    links = written(verified(tested, texts, least))
    groups = components(links)

    def still_split() -> DataFrame:
        """Rows (band, value, node, n, root) of buckets that hold several groups."""
        named = shared.join(groups, "node", "left").select("band", "value", "node", "n", F.coalesce("root", "node").alias("root"))
        split = named.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "value")
        return named.join(split, ["band", "value"])

    def tried(pairs: DataFrame) -> bool:
        """Verify new pairs and take their links in; false if there are none."""
        nonlocal tested, links, groups
        fresh = written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
        more = written(verified(fresh, texts, least))
        if more.isEmpty():
            return False
        tested, links = tested.unionByName(fresh), links.unionByName(more)
        groups = components(links)
        return True

    for _ in range(HUB_ROUNDS):
        ends = links.select(F.explode(F.array("a", "b")).alias("node"))
        open_rows = written(still_split().join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node", "left"))
        hub = F.max_by(F.struct("node", "n", "root"), F.struct(F.coalesce("degree", F.lit(0)), F.xxhash64("node"))).alias("hub")
        met = open_rows.join(open_rows.groupBy("band", "value").agg(hub), ["band", "value"]).select(F.col("node").alias("x"), "n", "root", F.col("hub.node").alias("y"), F.col("hub.n").alias("m"), F.col("hub.root").alias("ry"))
        if not tried(met.where("root <> ry").where(reach)):
            break

    # What is left: nodes of split buckets, compared wherever a link is possible at all.
    open_nodes = written(still_split().select("node", "n", "root").distinct())
    tried(prefix_pairs(shingle_rows(open_nodes, texts), least))

    rooted = nodes.join(groups, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    joined = rows.join(rooted, "digest", "left").withColumn("root", F.coalesce("root", F.struct("id", "version")))
    return joined.select("id", "version", "copies", F.col("root.id").alias("group_id"), F.col("root.version").alias("group_version"))


def _grouped(docs: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """``docs`` packed, with group_id, is_first and copies beside each row."""
    groups = written(near_duplicate_groups(docs, doc_id, text, least))
    match = field(doc_id).eqNullSafe(F.col("id")) & (F.xxhash64(whole_text(field(text))) == F.col("version"))
    first = F.col("id").eqNullSafe(F.col("group_id")) & (F.col("version") == F.col("group_version"))
    return packed(docs).join(groups, match).select("row", "group_id", "version", first.alias("is_first"), "copies")


def with_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``group_id`` and ``is_first`` (the document that stands for its group)."""
    return unpacked(_grouped(docs, doc_id, text, least), group_id=F.col("group_id"), is_first=F.col("is_first"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each group, with exactly the columns of ``docs``.

    Of rows of equal id and text, any one stays.
    """
    first = _grouped(docs, doc_id, text, least).where("is_first")
    single = first.where("copies = 1").select("row")
    repeated = first.where("copies > 1").groupBy(field(doc_id), "version").agg(F.first("row").alias("row")).select("row")
    return unpacked(single.unionByName(repeated))
