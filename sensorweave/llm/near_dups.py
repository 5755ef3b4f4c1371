"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

Documents of equal shingle sets form a class, found by a digest of the set; only classes are compared.
A class is represented by its smallest key (with the smallest hash of the text, if that key has several).
A class has a signature of MinHash values of ``BITS`` bits, split into chunks of ``CHUNK`` values.
Each chunk is entered into the index once for each value left out, so the allowed error is enumerated.
By the pigeonhole principle, two signatures that differ in at most ``2 * (chunks - MEET) + 1`` values
agree in ``MEET`` chunks up to one value, hence meet in ``MEET`` buckets at least: all pairs within that
distance are found.  The number of chunks follows from the similarity, so that a pair at the threshold
is missed with a chance of less than ``MISS`` (pairs above it far less).

Buckets never give all their pairs.  First each member is paired with the bucket's hub, the member
that meets most others; pairs are confirmed on full shingle sets, and confirmed ones give components.
Then the members of buckets that still hold several components are compared with their pivot, the class
nearest to the hub among those linked with it.  Members that are apart after that are paired across
components by what tells them from the centre of the pivot's members: two sets of the similarity that are
not both near the centre share one of the first of these differences in any common order, so nothing is
lost, and frequent ones stand last, so copies that only share their template do not meet.  Pairs whose signatures are
too far apart go, the others are confirmed.  After that, any two classes that meet often enough are in
one component or were ruled out or compared.

Defined results: a text without a word, or null, has an empty set and is linked with nothing; one with
fewer words than a shingle has its whole word sequence as its shingle; rows with a null key get no
component and are not kept.  Rows of one key are one document for components, each with the class of its
own text; repeated rows of one key have the same result, so all of them are kept or none.  Other columns
of the input may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.llm._flat import byte_buffer, chunks, mix, ngram_hashes, token_hashes, token_spans
from sensorweave.llm._shared import Tables, small_side
from sensorweave.llm.components import connected_components

BITS = 16
CHUNK = 6
MISS = 1e-6
MEET = 2
#: Pairs of one hub that are confirmed together; a hub's text is sent once for so many.
PART = 100
#: Low bits of a rank that hold a hash; the bits above hold the number of meetings, up to their largest value.
RANK_BITS = 40

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def chunk_count(similarity: float) -> int:
    """Chunks needed so that a pair at the similarity meets in MEET buckets but for a chance of MISS.

    A chunk that agrees wholly gives CHUNK common buckets, one with a single error gives one.
    """
    whole, single = similarity**CHUNK, CHUNK * (1 - similarity) * similarity ** (CHUNK - 1)
    step = np.zeros(CHUNK + 1)
    step[[0, 1, CHUNK]] = 1 - whole - single, single, whole
    common, n = np.ones(1), 0
    while common[:MEET].sum() > MISS:
        common, n = np.convolve(common, step), n + 1
    return n


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    buf, offsets = byte_buffer(texts)
    upper = (buf >= ord("A")) & (buf <= ord("Z"))
    buf = buf + upper.astype(np.uint8) * np.uint8(32)
    starts, ends, counts = token_spans(~_SPACE[buf], offsets)
    hashes = token_hashes(buf, starts, ends)
    grams = ngram_hashes(hashes, words)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        else:
            out.append(ngram_hashes(hashes[at : at + n], n)[:1] if n else np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """``values`` MinHash values of BITS bits by set; rows of empty sets are 0."""
    out = np.zeros((len(sets), values), np.uint16)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate(sets)
    starts = (np.cumsum(sizes) - sizes)[full]
    high, low = (flat >> np.uint64(32)).astype(np.uint32), flat.astype(np.uint32) | np.uint32(1)
    with np.errstate(over="ignore"):
        for k in range(values):
            # another multiplier and another rotation for each value
            h = (high + np.uint32(0x9E3779B9 * (k + 1) & 0xFFFFFFFF)) * (low + np.uint32(2 * k * 0x85EBCA6B & 0xFFFFFFFE))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(13)
            least = np.minimum.reduceat(h, starts)
            out[full, k] = (mix(least) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def _features(documents: DataFrame, key: str, text: str, words: int, values: int) -> DataFrame:
    """(id, th, n, digest, sig) of every row; th is a hash of the text, digest is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], words)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in signatures(sets, values)], pa.binary())], names=["id", "th", "n", "digest", "sig"])

    return _texts(documents, key, text).mapInArrow(run, f"id {documents.schema[key].dataType.simpleString()}, th long, n long, digest binary, sig binary")


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def _index(classes: DataFrame, values: int) -> DataFrame:
    """(bucket, digest): every chunk of every signature, once for each value left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, values).astype(np.uint64)
            for at in range(0, values, CHUNK):
                for left_out in range(CHUNK):
                    bucket = np.full(len(sigs), at * CHUNK + left_out, np.uint64)
                    with np.errstate(over="ignore"):
                        for k in range(CHUNK):
                            if k != left_out:
                                bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + sigs[:, at + k])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), batch.column("digest")], names=["bucket", "digest"])

    return classes.select("digest", "sig").mapInArrow(run, "bucket long, digest binary")


def _near_signatures(pairs: DataFrame, classes: DataFrame, values: int, similarity: float) -> DataFrame:
    """(a, b, ida, idb, tha, thb, far) of the pairs whose set sizes and signatures allow the similarity.

    The sizes rule is exact; the signature rule drops pairs that differ in more values than a pair at
    the threshold does but for a chance of about 1e-9.
    """
    most = int((1 - similarity) * values + 6 * math.sqrt(similarity * (1 - similarity) * values)) + 1
    left, right = (classes.select(F.col("digest").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"), F.col("first_id").alias(f"id{x}"), F.col("th").alias(f"th{x}")) for x in "ab")
    ratio = int(round(similarity * 100))
    joined = pairs.join(left, "a").join(right, "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * ratio))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, values) for c in ("sa", "sb"))
            far = (sa != sb).sum(1)
            near = pa.array(far <= most)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(near) for c in PAIR), pa.array(far.astype(np.int32)).filter(near)], names=[*PAIR, "far"])

    id_type = classes.schema["first_id"].dataType.simpleString()
    return joined.select(*PAIR, "sa", "sb").mapInArrow(run, f"a binary, b binary, ida {id_type}, idb {id_type}, tha long, thb long, far int")


#: Columns of a pair: the digests of both classes, and the first keys and text hashes that represent them.
PAIR = ["a", "b", "ida", "idb", "tha", "thb"]


def _texts_of(tables: Tables, needed: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, text) of the classes of ``needed`` (digest, id, th), one row each."""
    needed = tables.add(needed.distinct())
    return tables.add(_texts(documents, key, text).join(small_side(needed), ["id", "th"]).groupBy("digest").agg(F.first("text").alias("text")))


def _by_hub(tables: Tables, pairs: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """(kind, id, digest, text): each hub (``a``, kind 0) followed by partners of it (``b``, kind 1).

    A hub's partners are dealt to parts of about ``PART``; each part gets the hub's text once and then
    its partners' texts in a stream, so neither a task nor a batch follows the size of a group.
    """
    texts = _texts_of(tables, pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("digest"), F.col(f"id{x}").alias("id"), F.col(f"th{x}").alias("th")) for x in "ab"])).alias("x")).select("x.*"), documents, key, text)
    parts = tables.add(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    dealt = tables.add(pairs.join(parts, "a").select("a", "b", "ida", "idb", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")))
    hubs = dealt.select("a", "part", "ida").distinct().join(texts.withColumnRenamed("digest", "a"), "a").select("a", "part", F.lit(0).alias("kind"), F.col("ida").alias("id"), F.col("a").alias("digest"), "text")
    others = dealt.join(texts.withColumnRenamed("digest", "b"), "b").select("a", "part", F.lit(1).alias("kind"), F.col("idb").alias("id"), F.col("b").alias("digest"), "text")
    return hubs.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "kind").select("kind", "id", "digest", "text")


def _confirmed(tables: Tables, pairs: DataFrame, documents: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """(a, b, hub, partner, differ) of the pairs whose full shingle sets reach the similarity: first keys, digests, and how many shingles only one of them has."""
    percent = int(round(similarity * 100))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_id, hub_digest = np.zeros(0, np.uint64), None, None
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for i, j in chunks(texts):
                batch = whole.slice(i, j - i)
                linked = []
                for kind, key_of, digest, own in zip(*(batch.column(c).to_pylist() for c in ("kind", "id", "digest")), shingle_sets(texts[i:j], words), strict=True):
                    if kind == 0:
                        hub, hub_id, hub_digest = own, key_of, digest
                    else:
                        common = len(np.intersect1d(hub, own, assume_unique=True))
                        if common and 100 * common >= percent * (len(hub) + len(own) - common):
                            linked.append((hub_id, key_of, hub_digest, digest, len(hub) + len(own) - 2 * common))
                id_type = batch.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*linked, strict=True) if linked else [()] * 5, (id_type, id_type, pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "hub", "partner", "differ"])

    id_type = pairs.schema["ida"].dataType.simpleString()
    return tables.add(_by_hub(tables, pairs, documents, key, text).mapInArrow(compare, f"a {id_type}, b {id_type}, hub binary, partner binary, differ long"))


def _relabelled(tables: Tables, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of all first keys with links, after further ``links`` (a, b).

    Only the components so far are linked anew, not their nodes.
    """
    if labels is None:
        return tables.add(connected_components(links, tables=tables))
    if links.isEmpty():
        return labels
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = tables.add(labels.join(ends, "node", "full").select("node", F.coalesce("component", "node").alias("component")))
    of_a, of_b = (nodes.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    merged = tables.add(connected_components(links.join(of_a, "a").join(of_b, "b"), "of_a", "of_b", tables=tables))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return tables.add(nodes.join(small_side(merged), "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def _placed(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(digest, first_id, th, component) of every class; a class without links is its own component."""
    joined = classes.select("digest", "first_id", "th").join(labels.withColumnRenamed("node", "first_id"), "first_id", "left")
    return joined.select("digest", "first_id", "th", F.coalesce("component", "first_id").alias("component"))


def _mixed(tables: Tables, index: DataFrame, hubs: DataFrame, ranks: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b, ida, idb, tha, thb) of hubs and the members of their buckets that meet members of other components there.

    A member of less than MEET buckets with several components is left out, as is a bucket whose
    members but the hub are of one component.
    """
    member = tables.add(index.join(placed.select("digest", F.xxhash64("component").alias("of")), "digest").join(hubs, "bucket").select("bucket", "digest", "of", "hub", (F.col("rank") != F.col("hub")).alias("other")))
    of = F.when(F.col("other"), F.col("of"))
    mixed = tables.add(member.groupBy("bucket").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.coalesce(F.min(of) != F.max(of), F.lit(False)).alias("open")).where("lo != hi").select("bucket", "open"))
    member = member.join(mixed, "bucket")
    often = member.groupBy("digest").agg(F.count("*").alias("_n")).where(F.col("_n") >= MEET).select("digest")
    found = member.where("open and other").select("hub", "digest").distinct().join(often, "digest")
    left, right = (placed.select(F.col("digest").alias(x), F.col("first_id").alias(f"id{x}"), F.col("th").alias(f"th{x}")) for x in "ab")
    found = found.join(ranks.select(F.col("rank").alias("hub"), F.col("digest").alias("a")), "hub").withColumnRenamed("digest", "b")
    return tables.add(found.join(left, "a").join(right, "b").select(PAIR))


def _around_pivots(tables: Tables, mixed: DataFrame, links: DataFrame, placed: DataFrame) -> DataFrame:
    """``mixed`` with each hub replaced by its pivot: the nearest class that is linked with it, if any.

    All members of a group of slightly different copies differ from their hub by its own differences;
    the one nearest to it has the fewest of its own, so it is linked with more of the others.
    """
    nearest = links.groupBy(F.col("hub").alias("a")).agg(F.min(F.struct("differ", "partner")).alias("x")).select("a", F.col("x.partner").alias("p"))
    pivots = placed.select(F.col("digest").alias("p"), F.col("first_id").alias("idp"), F.col("th").alias("thp")).join(nearest, "p")
    found = mixed.join(pivots, "a", "left").select(F.coalesce("p", "a").alias("a"), "b", F.coalesce("idp", "ida").alias("ida"), "idb", F.coalesce("thp", "tha").alias("tha"), "thb")
    return tables.add(found.where("a != b").distinct())


def _open(tables: Tables, mixed: DataFrame, placed: DataFrame) -> DataFrame:
    """``mixed`` with ``of``, a hash of the member's component, without pivots whose members are all of one component."""
    found = tables.add(mixed.join(placed.select(F.col("digest").alias("b"), F.xxhash64("component").alias("of")), "b").select(*PAIR, "of"))
    several = found.groupBy("a").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo != hi").select("a")
    return tables.add(found.join(several, "a"))


def _across(tables: Tables, mixed: DataFrame, documents: DataFrame, key: str, text: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) as first keys, and pairs (a, b) of digests, each once, that hold all further links of a pivot's members.

    The shingles that more than half of a pivot's members have are its centre.  Let D(x) be the shingles that
    only one of x and the centre has.  If D(x) and D(y) together are no more than the shingles in which x and
    y may differ, x and y are linked; then the member with the least D for its size is linked with both.
    Otherwise x and y are linked exactly if D(x) and D(y) have ``shared`` shingles in common, one at least, so
    one is among the first of D(x) and of D(y) in any common order: here that of their counts.  A shingle in the D of
    a single member makes no pair, so it is only counted in a member's places.
    """
    percent = int(round(similarity * 100))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, group = np.zeros(0, np.uint64), b""
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for i, j in chunks(texts):
                kinds, digests = (whole.column(c).slice(i, j - i) for c in ("kind", "digest"))
                found, groups, owner, sizes = [], [], [], []
                for at, (kind, digest, own) in enumerate(zip(kinds.to_pylist(), digests.to_pylist(), shingle_sets(texts[i:j], words), strict=True)):
                    if kind == 0:
                        pivot, group = own, digest
                        continue
                    found.append(np.setxor1d(pivot, own, assume_unique=True))
                    groups += [group] * len(found[-1])
                    owner.append(np.full(len(found[-1]), at))
                    sizes.append(np.full(len(found[-1]), len(own)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(groups, pa.binary()), digests.take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(found).view(np.int64))], names=["pivot", "digest", "n", "shingle"])

    held = tables.add(_by_hub(tables, mixed, documents, key, text).select("kind", "digest", "text").mapInArrow(differences, "pivot binary, digest binary, n long, shingle long"))
    member = tables.add(mixed.join(held.groupBy(F.col("pivot").alias("a"), F.col("digest").alias("b"), "n").agg(F.count("*").alias("d")), ["a", "b"]).select(F.col("a").alias("pivot"), F.col("b").alias("digest"), "idb", "of", "n", "d"))
    counts = held.groupBy("pivot", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    counts = tables.add(counts.join(small_side(member.groupBy("pivot").agg(F.count("*").alias("members"))), "pivot").withColumn("turned", F.col("times") * 2 > F.col("members")))
    counted = tables.add(held.select("pivot", "digest", "shingle").join(counts, ["pivot", "shingle"]))
    # shingles of most members' differences belong to the centre, or not to it, against the pivot
    turned = tables.add(counts.where("turned").select("pivot", "shingle", (F.col("members") - F.col("times")).alias("times")))
    lacking = member.select("pivot", "digest").join(small_side(turned), "pivot").join(counted.where("turned").select("pivot", "shingle", "digest"), ["pivot", "shingle", "digest"], "left_anti")
    member = member.join(turned.groupBy("pivot").agg(F.count("*").alias("all")), "pivot", "left").join(counted.where("turned").groupBy("pivot", "digest").agg(F.count("*").alias("own")), ["pivot", "digest"], "left")
    member = tables.add(member.select("pivot", "digest", "idb", "of", "n", (F.col("d") + F.coalesce("all", F.lit(0)) - 2 * F.coalesce("own", F.lit(0))).alias("d")))
    excess = (100 + percent) * F.col("d") - (100 - percent) * F.col("n")  # two members of a sum of 0 at most are linked
    least = tables.add(member.groupBy("pivot").agg(F.min(F.struct(excess.alias("e"), "digest", "idb")).alias("x")).select("pivot", "x.e", F.col("x.idb").alias("a")))
    links = tables.add(member.join(small_side(least), "pivot").where((excess + F.col("e") <= 0) & (F.col("a") != F.col("idb"))).select("a", F.col("idb").alias("b")))

    rows = counted.where("not turned").select("pivot", "digest", "shingle", "times").unionByName(lacking.where("times > 1").select("pivot", "digest", "shingle", "times"))
    one = Window.partitionBy("pivot", "digest")
    rows = rows.withColumn("several", F.count("*").over(one)).withColumn("nth", F.row_number().over(one.orderBy("times", "shingle")))
    rows = rows.join(member, ["pivot", "digest"]).withColumn("place", F.col("d") - F.col("several") + F.col("nth") - 1)
    posts = tables.add(rows.where(F.col("place") <= F.least(F.col("d") - 1, F.floor(F.col("n") * (100 - percent) / percent))).select("pivot", "shingle", "place", "n", "d", "digest", "of"))
    left, right = (posts.select("pivot", "shingle", *[F.col(c).alias(f"{c}_{x}") for c in posts.columns[2:]]) for x in "ab")
    both = F.col("n_a") + F.col("n_b")
    shared = F.ceil(both * percent / F.lit(100 + percent)) + (F.col("d_a") + F.col("d_b") - both) / 2
    near = (F.col("of_a") < F.col("of_b")) & (shared > 0) & (F.col("place_a") <= F.col("d_a") - shared) & (F.col("place_b") <= F.col("d_b") - shared)
    joined = left.join(right, (left["pivot"] == right["pivot"]) & (left["shingle"] == right["shingle"]) & near)
    return links, joined.select(F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b")).distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key that links reach, itself included), kept.

    Two documents are linked if 100 * intersection >= (100 * similarity) * union of their shingle sets.
    """
    values = CHUNK * chunk_count(similarity)
    tables = Tables(documents.sparkSession, "near-dups")
    rows = tables.add(_features(documents, key, text, words, values))
    named = rows.where("id is not null and digest is not null")
    classes = tables.add(named.groupBy("digest").agg(F.min(F.struct("id", "th", "n", "sig")).alias("x")).select("digest", F.col("x.id").alias("first_id"), "x.th", "x.n", "x.sig"))
    whole, rows = rows, tables.add(rows.select("id", "n", "digest"))
    tables.drop(whole)

    shared = tables.add(_index(classes, values).groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    index = tables.add(_index(classes, values).join(shared, "bucket"))
    meets = index.groupBy("digest").agg(F.sum("size").alias("_meets"))
    rank = F.shiftleft(F.least("_meets", F.lit((1 << 62 - RANK_BITS) - 1)), RANK_BITS) + F.xxhash64("digest").bitwiseAND(F.lit((1 << RANK_BITS) - 1))
    ranks = tables.add(meets.select("digest", rank.alias("rank")))
    unranked, index = index, tables.add(index.join(ranks, "digest").select("bucket", "digest", "rank"))
    tables.drop(unranked, shared)
    hubs = tables.add(index.groupBy("bucket").agg(F.max("rank").alias("hub")))
    met = index.join(hubs, "bucket").where("rank != hub").groupBy("hub", F.col("digest").alias("b")).agg(F.count("*").alias("_met")).where(F.col("_met") >= MEET)
    stars = met.join(ranks.select(F.col("rank").alias("hub"), F.col("digest").alias("a")), "hub").select("a", "b")
    stars = tables.add(_near_signatures(stars, classes, values, similarity))

    best = tables.add(stars.groupBy("b").agg(F.min(F.struct("far", "a", "ida", "idb", "tha", "thb")).alias("x")).select("x.a", "b", "x.ida", "x.idb", "x.tha", "x.thb"))
    links = _confirmed(tables, best, documents, key, text, words, similarity)
    labels = _relabelled(tables, None, links)

    of_a, of_b = (labels.select(F.col("node").alias(f"id{x}"), F.col("component").alias(f"of_{x}")) for x in "ab")
    apart = F.coalesce("of_a", "ida") != F.coalesce("of_b", "idb")  # classes that are not in one component yet
    rest = stars.join(best.select("a", "b"), ["a", "b"], "left_anti").join(of_a, "ida", "left").join(of_b, "idb", "left").where(apart).select(PAIR)
    placed = tables.add(_placed(classes, labels))
    mixed = _around_pivots(tables, _mixed(tables, index, hubs, ranks, placed), links, placed)
    of_a, of_b = (placed.select(F.col("digest").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    pivots = mixed.join(of_a, "a").join(of_b, "b").where("of_a != of_b").select("a", "b").join(stars.select("a", "b"), ["a", "b"], "left_anti")
    rest = tables.add(rest.unionByName(_near_signatures(pivots, classes, values, similarity).select(PAIR)))
    labels = _relabelled(tables, labels, _confirmed(tables, rest, documents, key, text, words, similarity))

    mixed = _open(tables, mixed, _placed(classes, labels))
    links, across = _across(tables, mixed, documents, key, text, words, similarity)
    across = across.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    across = tables.add(_near_signatures(across, classes, values, similarity).select(PAIR))
    links = links.unionByName(_confirmed(tables, across, documents, key, text, words, similarity).select("a", "b"))
    labels = _relabelled(tables, labels, links)

    placed = tables.add(_placed(classes, labels).select("digest", F.col("component").alias("component_id")))
    tables.keep_only(rows, placed)
    by_row = rows.where("digest is not null").join(placed, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    found = by_row.unionByName(rows.where("digest is null").select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
