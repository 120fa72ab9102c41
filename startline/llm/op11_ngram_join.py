"""N-gram Jaccard join: adaptive multi-match prefixes, exact sets, connected components.

A document's set is its distinct word shingles as 64-bit hashes, and documents of equal sets are one class. Two sets
of similarity s share at least tau = ceil(s n) shingles of either, so in any common order of all shingles the first
n - tau + l of both have at least l shingles in common, for every l (the l-prefix). A class chooses its own l: a longer
prefix meets more classes, but only those that share l with it are verified; two classes must share the smaller l.

The order: shingles of the lower quarter of the hashes by the number of classes that hold them, rarest first, then the
others by hash, then those that a hundredth or so of all documents hold, by number. Only that quarter is counted, by
hash ranges over all documents, and a class whose shortest prefix is unique to it ends there; that is most classes.

What is left meets under prefix shingles. Every shingle has a hub, the class with the fewest shingles of its own among
those that have it in their prefix, and a meeting is all classes that share a hub: a class with fifty common prefix
shingles sits in one or two meetings, not fifty. A meeting is settled in its task: shared prefix shingles are counted
by one matrix product, the pairs with enough of them are verified on the whole sets, and links leave the task only if
they join something new. Meetings beyond CHUNK classes or CHUNK_SHINGLES shingles are compared with their hub first;
the classes that this does not join to it go in chunks, every pair of chunks a task of its own. No pair is a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from startline.llm.common import byte_values, coded_words, materialise, pieces, salt_of, schema_of, with_least
from startline.llm.op10_simhash import components

SHINGLE, PERCENT, SEED = 3, 90, 42
#: Bytes of text that a task turns to sets at once; longer texts go in parts of it.
SCAN_BYTES = 8 << 20
#: One shingle in so many is counted; the longest l that a class may choose.
COUNTED, LONGEST = 4, 8
#: A shingle is frequent if batches that hold it FREQUENT_IN_BATCH times add up to a share of documents, and LEAST_FREQUENT.
FREQUENT_IN_BATCH, FREQUENT_SHARE, LEAST_FREQUENT = 16, 200, 256
#: Entries of 12 bytes that a hash range holds, about; classes and shingles of a chunk.
RANGE_ENTRIES, CHUNK, CHUNK_SHINGLES = 1 << 20, 1024, 2 << 20
#: Documents that are looked up by a broadcast at most; more are joined.
BROADCAST_ROWS, SALTS = 1 << 20, 64
SEPARATES = np.zeros(256, bool)
SEPARATES[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits depend on all input bits."""
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def factors(shingle: int) -> np.ndarray:
    return mixed(np.arange(1, shingle + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles_of(values: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a sequence of word hashes, repeats included; a shorter sequence is one."""
    if not len(values):
        return values
    by, n = factors(shingle), len(values)
    if n < shingle:
        return mixed((values * by[:n]).sum(keepdims=True) + by[-1:] * np.uint64(n))
    total = values[: n - shingle + 1] * by[0]
    for k in range(1, shingle):
        total += values[k : n - shingle + 1 + k] * by[k]
    return mixed(total)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    starts, _, coded = coded_words(raw, SEPARATES[raw])
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    values = of_word[coded.indices.to_numpy(zero_copy_only=False)]
    cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
    return [np.unique(shingles_of(values[a:z], shingle)) for a, z in zip([0, *cuts[:-1]], cuts, strict=True)]


def long_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """shingle_sets() of one long text, in parts that share shingle - 1 words."""
    found, rest, at = [], b"", 0
    while at < len(text):
        end = at + SCAN_BYTES
        while end < len(text) and not SEPARATES[text[end]]:
            end += 1
        part = rest + b" " + text[at:end]
        words = len(part.split(None, shingle)[:shingle])
        if words == shingle or end >= len(text) and not found:
            found = [np.unique(np.concatenate([*found, *shingle_sets([part], shingle)]))]
        rest = b" ".join(part.rsplit(None, shingle - 1)[-(shingle - 1) :]) if words == shingle else part
        at = end
    return found[0] if found else np.zeros(0, np.uint64)


def sets_of_batch(batch: pa.RecordBatch, column: int, shingle: int) -> list[np.ndarray]:
    texts = [t or b"" for t in byte_values(batch.column(column))]
    if max(map(len, texts)) > 2 * SCAN_BYTES:
        return [long_set(t, shingle) for t in texts]
    return shingle_sets(texts, shingle)


def class_key(found: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for the empty one."""
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def read_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key, n for each row, and one row for each batch with the shingles that are frequent in it."""
    item = pa.struct([("token", pa.int64()), ("n", pa.int64())])

    def work(batches):
        for batch in pieces(batches, SCAN_BYTES):
            sets = sets_of_batch(batch, 1, shingle)
            keys = [class_key(s) for s in sets]
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *dict(zip(keys, sets, strict=True)).values()]), return_counts=True)
            hot = n >= FREQUENT_IN_BATCH
            rows = [{"token": t, "n": c} for t, c in zip(token[hot].view(np.int64).tolist(), n[hot].tolist(), strict=True)]
            ids = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
            yield pa.RecordBatch.from_arrays([ids, pa.array([*keys, None], pa.binary()), pa.array([*map(len, sets), None], pa.int64()), pa.array([None] * len(sets) + [rows], pa.list_(item))], ["doc_id", "key", "n", "hot"])

    return docs.mapInArrow(work, schema_of(docs, "doc_id", "key binary, n long, hot array<struct<token long, n long>>"))


def counted_entries(docs: DataFrame, shingle: int, ranges: int, frequent) -> DataFrame:
    """By hash range the shingles that are counted and whose they are, packed; kind 0 rows carry keys, n and the number counted."""
    width = -(-(1 << 64) // COUNTED // ranges)

    def work(batches):
        hot = frequent.value[0]
        for batch in pieces(batches, SCAN_BYTES):
            own = {class_key(s): s for s in sets_of_batch(batch, 1, shingle) if len(s)}
            if not own:
                continue
            keys, sets = list(own), list(own.values())
            counted = [s[: np.searchsorted(s, np.uint64((1 << 64) // COUNTED))] for s in sets]
            counted = [c[~among(hot, c)] for c in counted]
            joined, sizes = b"".join(keys), np.array([len(c) for c in counted])
            rows = [(xxhash.xxh32_intdigest(joined) % ranges, 0, joined, np.array([len(s) for s in sets], np.int64).tobytes(), sizes.astype(np.int64).tobytes())]
            token, owner = np.concatenate(counted), np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            at = (token // np.uint64(width)).astype(np.int64)
            cuts = np.searchsorted(at, np.arange(ranges + 1))
            for r in np.unique(at).tolist():
                here = slice(cuts[r], cuts[r + 1])
                who, inverse = np.unique(owner[here], return_inverse=True)
                rows.append((r, 1, b"".join(keys[i] for i in who.tolist()), inverse.astype(np.uint32).tobytes(), token[here].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in enumerate((pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary()))], ["range", "kind", "keys", "first", "second"])

    return docs.mapInArrow(work, "range int, kind byte, keys binary, first binary, second binary")


def among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def shared_entries(entries: DataFrame) -> DataFrame:
    """key with n and counted, or with packed shingles that several classes hold and the numbers of these classes."""
    rows = entries.repartition("range").sortWithinPartitions("range", "kind")

    def shared(held: list) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(k, "V16") for k, _, _ in held])
        pair = keys.view(np.uint64).reshape(-1, 2)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        fresh = np.concatenate(([True], (pair[order][1:] != pair[order][:-1]).any(axis=1)))
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(fresh) - 1
        names, base = keys[order][fresh], np.cumsum([0, *(len(k) // 16 for k, _, _ in held[:-1])])
        owner = number[np.concatenate([np.frombuffer(o, np.uint32).astype(np.int64) + b for (_, o, _), b in zip(held, base, strict=True)])]
        token = np.concatenate([np.frombuffer(t, np.uint64) for _, _, t in held])
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
        token, owner = token[fresh], owner[fresh]
        start = np.nonzero(np.concatenate(([True], token[1:] != token[:-1])))[0]
        count = np.diff(np.append(start, len(token)))
        many = np.repeat(count, count)
        keep = many > 1
        token, owner, many = token[keep], owner[keep], many[keep].astype(np.uint32)
        order = np.argsort(owner, kind="stable")
        token, owner, many = token[order], owner[order], many[order]
        start = np.nonzero(np.concatenate(([True], owner[1:] != owner[:-1])))[0] if len(owner) else np.zeros(0, np.int64)
        spans = list(zip(start.tolist(), [*start[1:].tolist(), len(owner)], strict=True)) if len(start) else []
        columns = [[names[owner[a]].tobytes() for a, _ in spans], [token[a:z].tobytes() for a, z in spans], [many[a:z].tobytes() for a, z in spans]]
        none = pa.nulls(len(spans), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), none, none, *(pa.array(c, pa.binary()) for c in columns[1:])], ["key", "n", "counted", "tokens", "numbers"])

    def work(batches):
        at, held = None, []
        for batch in batches:
            for r, kind, keys, first, second in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r != at:
                    yield shared(held)
                    held = []
                at = r
                if kind:
                    held.append((keys, first, second))
                else:
                    own = [keys[i : i + 16] for i in range(0, len(keys), 16)]
                    none = pa.nulls(len(own), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), *(pa.array(np.frombuffer(x, np.int64)) for x in (first, second)), none, none], ["key", "n", "counted", "tokens", "numbers"])
        if held:
            yield shared(held)

    return rows.mapInArrow(work, "key binary, n long, counted long, tokens binary, numbers binary")


def overlap_of(n, percent: int):
    """The shingles that a set of n shares at least with any it links to; works on numbers and columns."""
    return (n * percent + 99) // 100


def prefix_of(found: np.ndarray, shared: np.ndarray, numbers: np.ndarray, hot: np.ndarray, hot_numbers: np.ndarray, percent: int) -> tuple[np.ndarray, int, float]:
    """Shingles of a set's prefix that others may have, the number l that a partner must share, and its share of unique ones."""
    n, counted = len(found), int(np.searchsorted(found, np.uint64((1 << 64) // COUNTED)))
    frequent = among(hot, found)
    low, high = found[:counted][~frequent[:counted]], found[counted:][~frequent[counted:]]
    order = np.argsort(shared)
    shared, numbers = shared[order], numbers[order].astype(np.int64)
    known = np.ones(len(low), np.int64)
    known[np.searchsorted(low, shared)] = numbers
    order = np.lexsort((low, known))
    often = found[frequent]
    counts = hot_numbers[np.searchsorted(hot, often)] if len(often) else np.zeros(0, np.int64)
    last = np.lexsort((often, counts))
    guess = max(2, int(known.mean())) if len(known) else 2
    tokens = np.concatenate((low[order], high, often[last]))
    held = np.concatenate((known[order], np.full(len(high), guess, np.int64), counts[last]))
    least = n - overlap_of(n, percent) + 1
    met = np.cumsum(held - 1)
    lengths = np.arange(1, min(LONGEST, n - least + 1) + 1)
    # rows that meet, and sets of n that are verified: one in l of those met, where l must be shared
    cost = met[least + lengths - 2] * (1 + (20 + n / 50) / lengths)
    chosen = int(lengths[np.argmin(cost)])
    at = least + chosen - 1
    return tokens[:at][held[:at] > 1], chosen, float((known == 1).mean()) if len(known) else 0.0


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each sorted array of a shares with each of b, by matrix products over blocks of the common values."""
    at, bt = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (a, b))
    ar, br = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b))
    common = np.intersect1d(at, bt)
    total = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return total
    (at, ar), (bt, br) = ((np.searchsorted(common, t[k]), r[k]) for t, r, k in ((at, ar, among(common, at)), (bt, br, among(common, bt))))
    for low in range(0, len(common), 4096):
        width = min(4096, len(common) - low)
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ka, kb = (at >= low) & (at < low + width), (bt >= low) & (bt < low + width)
        left[ar[ka], at[ka] - low] = 1
        right[br[kb], bt[kb] - low] = 1
        total += left @ right.T
    return total


def linked_pairs(a: list[tuple], b: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """Identifiers that link and join something new; rows are (id, root, need, prefix, set). All of a, or a with b."""
    others = a if b is None else b
    label: dict[int, int] = {}

    def root(x: int) -> int:
        while label.get(x, x) != x:
            x = label[x]
        return x

    size_a, size_b = (np.array([len(r[4]) for r in x]) for x in (a, others))
    need_a, need_b = (np.array([r[2] for r in x]) for x in (a, others))
    root_a, root_b = (np.array([r[1] for r in x]) for x in (a, others))
    may = (root_a[:, None] != root_b[None, :]) & (100 * np.minimum(size_a[:, None], size_b) >= percent * np.maximum(size_a[:, None], size_b))
    if b is None:
        may = np.triu(may, 1)
    if may.any():
        may &= common_counts([r[3] for r in a], [r[3] for r in others]) >= np.minimum(need_a[:, None], need_b)
    left, right = np.nonzero(may.any(axis=1))[0], np.nonzero(may.any(axis=0))[0]
    if not len(left):
        return []
    if np.count_nonzero(may) > 2 * (len(left) + len(right)):
        both = common_counts([a[i][4] for i in left], [others[j][4] for j in right]).astype(np.int64)
        x, y = np.nonzero(may[np.ix_(left, right)])
        shared, x, y = both[x, y], left[x], right[y]
    else:
        x, y = np.nonzero(may)
        shared = np.array([int(np.count_nonzero(among(a[i][4], others[j][4]))) for i, j in zip(x.tolist(), y.tolist(), strict=True)])
    ok = 100 * shared >= percent * (size_a[x] + size_b[y] - shared)
    links = []
    for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
        p, q = root(a[i][1]), root(others[j][1])
        if p != q:
            links.append((a[i][0], others[j][0]))
            label[q] = p
    return links


LINKS = "a long, b long"


def link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], pa.int64()) for n in (0, 1)], ["a", "b"])


def hub_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of classes with the hub of a large meeting."""

    def work(batches):
        for batch in batches:
            links = []
            for x, hub, own, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, other = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                shared = int(np.count_nonzero(among(own, other))) if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)) else 0
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    links.append((x, hub))
            yield link_batch(links)

    pairs = met.where("id <> hub").select("id", "hub").join(sets.select("id", "hashes"), "id")
    return pairs.join(sets.select(F.col("id").alias("hub"), F.col("hashes").alias("others")), "hub").select("id", "hub", "hashes", "others").mapInArrow(work, LINKS)


def chunked(met: DataFrame, roots: DataFrame) -> DataFrame:
    """hub, lo, hi, chunk, id, root: the classes of each meeting in every pair of chunks that may hold a new link.

    A meeting of one chunk is whole. Of a larger one the hub, and what the hub's component has, is left out among
    itself, as it is joined already.
    """
    placed = met.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    hearts = placed.where("chunks > 1 AND id = hub").select("hub", F.col("root").alias("heart"))
    placed = placed.join(hearts, "hub", "left").where("chunks = 1 OR id <> hub")
    placed = materialise(placed.withColumn("inside", F.coalesce(F.col("root") == F.col("heart"), F.lit(False))).drop("heart"), "placed")
    count = placed.groupBy("hub").agg(F.sum(F.when(F.col("inside"), 0).otherwise(1)).alias("out"), F.count(F.lit(1)).alias("all"), F.max("chunks").alias("chunks"))
    outs = F.ceil(F.col("chunks") * F.col("out") / F.col("all")).cast("int")
    ins = F.ceil(F.col("chunks") * (F.col("all") - F.col("out")) / F.col("all")).cast("int")
    count = count.where("out > 0 AND all > 1").select("hub", outs.alias("outs"), ins.alias("ins"))
    rows, spread = placed.join(count, "hub"), F.xxhash64(F.lit(5), "id")
    own = F.when(F.col("inside"), F.col("outs") + F.pmod(spread, F.greatest("ins", F.lit(1)))).otherwise(F.pmod(spread, F.col("outs"))).cast("int")
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("outs") - 1)).otherwise(F.sequence(F.lit(0), F.col("outs") + F.col("ins") - 1))
    rows = rows.withColumn("chunk", own).withColumn("other", F.explode(others))
    return rows.select("hub", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "id", "root")


def meeting_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links within the meetings' pairs of chunks; rows carry need, prefix and hashes."""
    keys = ["hub", "lo", "hi"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "chunk", "id", "root", "need", "prefix", "hashes")

    def settled(at: tuple, held: dict[int, list]) -> list[tuple[int, int]]:
        _, lo, hi = at
        if lo == hi:
            return linked_pairs(held[lo], None, percent)
        return linked_pairs(held[lo], held[hi], percent) if lo in held and hi in held else []

    def work(batches):
        at, held = None, {}
        for batch in batches:
            links = []
            for hub, lo, hi, chunk, id_, root, need, prefix, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hub, lo, hi) != at:
                    links += settled(at, held) if held else []
                    at, held = (hub, lo, hi), {}
                held.setdefault(chunk, []).append((id_, root, need, np.frombuffer(prefix, np.uint64), np.frombuffer(raw, np.uint64)))
            yield link_batch(links)
        if held:
            yield link_batch(settled(at, held))

    return dealt.mapInArrow(work, LINKS)


def prefixed(survivors: DataFrame, frequent, percent: int) -> DataFrame:
    """id, n, need, rank, prefix and hashes (bytes) and tokens (the prefix as an array), from id, hashes and shared entries."""

    def work(batches):
        hot, hot_numbers = frequent.value
        for batch in batches:
            rows = []
            for id_, raw, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = np.frombuffer(b"".join(e["tokens"] for e in entries), np.uint64)
                numbers = np.frombuffer(b"".join(e["numbers"] for e in entries), np.uint32)
                prefix, need, alone = prefix_of(np.frombuffer(raw, np.uint64), shared, numbers, hot, hot_numbers, percent)
                rows.append((id_, len(raw) // 8, need, alone, np.sort(prefix).tobytes(), raw, prefix.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], ["id", "n", "need", "alone", "prefix", "hashes", "tokens"])

    return survivors.select("id", "hashes", "entries").mapInArrow(work, "id long, n long, need int, alone double, prefix binary, hashes binary, tokens array<long>")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id (the smallest identifier that links reach).

    Texts of fewer words than a shingle are one shingle; null texts and texts without words have none and are their
    own component. Texts of equal sets are linked. Null identifiers are never the smallest unless a component has no
    other. Repeated rows are members of one component. An empty table gives an empty result. Other columns are not
    read. Shingles are told apart by 64 bits of hash, classes by 128: two different shingles of one pair of sets of m
    shingles are taken for one with a chance of m^2 / 2^63.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = materialise(read_sets(rows, shingle), "sets-read")
    keys = read.where("hot IS NULL").select("doc_id", "key", "n").withColumn("salt", salt_of("doc_id", salts=SALTS))
    total = keys.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    often = read.where("hot IS NOT NULL").select(F.explode("hot").alias("h")).groupBy("h.token").agg(F.sum("h.n").alias("n"))
    often = often.where(F.col("n") >= max(LEAST_FREQUENT, total["rows"] // FREQUENT_SHARE)).collect()  # FREQUENT_SHARE times a document's mean number of shingles at most
    often = sorted((r["token"] % (1 << 64), r["n"]) for r in often)
    frequent = spark.sparkContext.broadcast((np.array([t for t, _ in often], np.uint64), np.array([n for _, n in often], np.int64)))

    ranges = max(1, -(-(total["n"] or 0) // COUNTED // RANGE_ENTRIES))
    entries = shared_entries(counted_entries(rows, shingle, max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))), frequent))
    shared = F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)) / 8
    found = entries.groupBy("key").agg(
        F.max("n").alias("n"), (F.max("counted") - shared).alias("unique"), F.collect_list(F.when(F.col("tokens").isNotNull(), F.struct("tokens", "numbers"))).alias("entries")
    )
    left = found.where(F.col("unique") < F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).select("key", "entries")
    left = materialise(left.withColumn("id", F.monotonically_increasing_id()), "prefixes-shared")

    part = keys.where("key IS NOT NULL").groupBy("key", "salt").agg(F.min("doc_id").alias("least"))
    classes = materialise(part.groupBy("key").agg(F.min("least").alias("least")).join(left.select("key", "id"), "key", "left"), "classes")
    wanted = classes.where("id IS NOT NULL").select(F.col("least").alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if left.count() <= BROADCAST_ROWS else wanted
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.doc_id), "left_semi")

    def whole(batches):
        for batch in pieces(batches, SCAN_BYTES):
            sets = sets_of_batch(batch, 1, shingle)
            yield pa.RecordBatch.from_arrays([pa.array([class_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "hashes"])

    survivors = texts.mapInArrow(whole, "key binary, hashes binary").join(left, "key").dropDuplicates(["key"])
    sets = materialise(prefixed(survivors, frequent, percent), "prefixes")

    tokens = materialise(sets.select("id", F.struct("alone", "id").alias("rank"), F.explode("tokens").alias("token")), "prefix-tokens")
    met = with_least(tokens, "token", "rank", "hub").select(F.col("hub.id").alias("hub"), "id").distinct()
    met = materialise(met.join(sets.select("id", "n"), "id"), "met")
    size = met.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks")).where("members > 1")
    met = materialise(met.join(size.select("hub", "chunks"), "hub").select("hub", "id", "chunks"), "meetings")
    first = materialise(hub_links(met.where("chunks > 1"), sets, percent), "hub-links")
    rest = chunked(met, components(first, "ngram-hubs")).join(sets.select("id", "need", "prefix", "hashes"), "id")
    roots = components(first.union(meeting_links(rest, percent)), "ngram")

    nodes = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "least", F.coalesce("root", "id").alias("root"))
    linked = with_least(materialise(nodes.where("root IS NOT NULL"), "nodes"), "root", "least", "component", spread="key").select("key", "component")
    alone = nodes.where("root IS NULL").select("key", F.col("least").alias("component"))
    back = part.select("key", "salt").join(linked.union(alone), "key")
    joined = keys.where("key IS NOT NULL").join(back, ["key", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return joined.union(keys.where("key IS NULL").select("doc_id", F.lit(0).cast("long"), "doc_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
