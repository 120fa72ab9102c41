"""The pipeline against plain versions of its stages, and its stages over awkward rows."""

import re
import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline as p
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from startline.llm import op05_decontaminate as op5
from startline.llm import op06_mixture as op6
from startline.llm import op08_language_id as op8

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_language(docs):
    """Rejected ids: dictionaries of the commonest words of each language, the smallest zstandard size wins by 0.3 %."""
    fold = lambda t: re.sub(r"[\W\d_]+", " ", (t or "").lower()).strip().encode()
    counts: dict = {}
    for d, text, lang, _ in docs:
        if zlib.crc32(str(d).encode()) % 4 != 2 and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(fold(text).decode().split())
    tools = {}
    for lang, c in sorted(counts.items()):
        words, size = [], 0
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0].encode())):
            size += len(w.encode()) + 1
            if size > op8.DICTIONARY:
                break
            words.append((n, w))
        data = (" " + " ".join(w for _, w in sorted(words)) + " ").encode()
        table = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools[lang] = zstandard.ZstdCompressor(level=op8.LEVEL, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = set()
    for d, text, *_ in docs:
        raw = fold(text)
        sizes = sorted(sum(len(tool.compress(raw[i : i + op8.PIECE])) for i in range(0, len(raw), op8.PIECE)) for tool in tools.values())
        if not raw or (sizes[1] - sizes[0]) / sizes[1] < op8.MARGIN:
            out.add(d)
    return out


def plain_groups(docs):
    """Smallest ids of groups: fingerprints within four bits, then five-word shingles of similarity 0.8."""

    def closed(ids, linked):
        root = {d: d for d in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in combinations(sorted(ids), 2):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        return {d for d in ids if find(d) == d}

    words = {d: SPACES.findall(lower(t)) for d, t, *_ in docs}
    parts = lambda w, n: [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    prints = {}
    for d, w in words.items():
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts(w, 4)]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    stay = closed(set(words), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    sets = {d: set(parts(words[d], 5)) for d in stay}
    return closed(stay, lambda a, b: bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_pipeline_against_brute_force(spark, duck, data):
    rows = duck.sql("SELECT doc_id, text, lang, source FROM documents ORDER BY 1").fetchall()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    rejected = plain_language(rows)
    kept = [r for r in rows if r[0] not in rejected]
    one = p.identify_language(spark, docs, data)
    assert ids(one) == [r[0] for r in kept]

    stay = plain_groups(kept)
    kept = [r for r in kept if r[0] in stay]
    two = p.near_dedup(spark, one, data)
    assert ids(two) == [r[0] for r in kept]

    windows = set()
    for (text,) in duck.sql("SELECT text FROM benchmark").fetchall():
        w = WORDS.findall(lower(text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}
    hit = {d for d, t, *_ in kept for w in [WORDS.findall(lower(t))] for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows}
    kept = [r for r in kept if r[0] not in hit]
    three = p.drop_contaminated(spark, two, data)
    assert ids(three) == [r[0] for r in kept] and hit

    four = p.mix(spark, three, data)
    copies = Counter(ids(four))
    size = {d: len(SPACES.findall(t or "")) for d, t, *_ in kept}
    source = {d: s for d, _, _, s in kept}
    whole: dict = {}
    for d in size:
        whole[source[d]] = whole.get(source[d], 0) + size[d]
    names = sorted(whole, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(whole.values()) - sum(3 * whole[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * whole[s] if s in capped else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in capped and target[s] > 3 * whole[s]}
        if not more:
            break
        capped |= more
    for s in names:
        assert abs(sum(copies[d] * size[d] for d in size if source[d] == s) - target[s]) <= min(size[d] for d in size if source[d] == s and size[d])  # one more would be too much
    assert set(copies) <= set(size) and max(copies.values()) <= 3

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(p.default_tokenizer())
    text, start, want = {r[0]: r[1] for r in kept}, 0, []
    for d in sorted(copies.elements()):
        tokens = tokenizer.encode(text[d], add_special_tokens=False).ids + [0]
        want.append((d, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert sorted(tuple(r) for r in p.encode(spark, four, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    assert sorted(tuple(r) for r in p.run(spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


WORDY = " ".join(f"the cat sat on mat number {n} and then went away" for n in range(20))
OTHER = " ".join(f"a dog ran over field {n} while rain fell down" for n in range(20))
ROWS = [
    (1, WORDY, "en", "a", 1), (2, WORDY, "en", "a", 2), (2, WORDY, "en", "a", 2), (2, OTHER, "en", "b", 3), (None, OTHER + " quite otherwise than all the rest of these", "en", "b", 4),
    (None, "une phrase sans numéro qui ne ressemble à aucune autre phrase du tout", "fr", None, 5), (3, None, None, None, 6), (4, "", "en", "a", 7), (5, " \t", None, "b", 8), (6, "1234 !!", "fr", "c", 9),
    (7, WORDY * 300, "en", "a", 10), (8, "la maison est grande et le jardin aussi", "fr", "c", 11), (9, OTHER.upper(), "en", "c", 12),
]
SCHEMA = "doc_id long, text string, lang string, source string, lang_pred int"
CLASHES = ("lang_score", "lang_rejected", "language", "key", "_key", "row", "size", "bin", "name", "rank", "copies", "fp", "salt", "root", "node", "n_hit", "ranges", "k1", "items", "start")


@pytest.mark.parametrize("which", ["awkward", "nulls", "empty"])
def test_stages_over_awkward_tables(spark, data, which):
    rows = {"awkward": ROWS, "nulls": [(None,) * 5] * 3, "empty": []}[which]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHES}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    before = docs
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, before, data)
        assert kept.columns == docs.columns, name
        found = [r.asDict() for r in kept.collect()]
        assert {r["lang_pred"] for r in found} <= {r[4] for r in rows}, name  # the user's own columns
        assert all(r[c] == f"own {c}" for r in found for c in CLASHES), name
        before = p.materialise(kept, "test")
        if which == "awkward" and name == "language ID":
            assert {r["lang_pred"] for r in found}.isdisjoint({6, 7, 8, 9}) and len(found) >= 8
        if which == "awkward" and name == "SimHash near-dedup":
            # the copies of 1 go, and those of the other text of 2; that text and a row without doc_id stay
            assert sorted(r["lang_pred"] for r in found) == sorted(set(r["lang_pred"] for r in found))
            assert {r["lang_pred"] for r in found} == {1, 3, 5, 11} | ({10} & {r["lang_pred"] for r in found})
    last = p.encode(spark, before, data).collect()
    assert len(last) == before.count()
    assert which == "awkward" or not last


def test_rows_alike_in_all_columns_are_mixed_each(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "x")] * 5 + [(2, "a b", "en", "y")] * 3, "doc_id long, text string, lang string, source string")
    assert op6.mix_sources(docs).count() == 8
    assert p.mix(spark, docs, "").columns == docs.columns


def test_blocks_pass_whole_rows(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    few, many = (sorted((r["doc_id"]["doc_id"], r["n_hit"], tuple(r["items"])) for r in op5.decontaminate(rows, bench, id_col="row", block_bytes=b).collect()) for b in (1 << 23, 200_000))
    assert few == many and any(n for _, n, _ in few)
