import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyflow.llm import byte_bpe, exact_dedup, line_dedup, simhash, token_counts

UPPER = {c: c + 32 for c in range(65, 91)}
TEXTS = [None, "", " ", "Abc É", "aBC É", "abc é", "x\ny", "X\nY", "\x00", "long " * 3000, "ﬁ　 <s> </s>", "a▁b", "  a   b ", "🙂 emoji 👩‍👩‍👧", "12345 1,234.5", "\t\tcode\n\n  x"]


def pairs(n=120, seed=1):
    r = random.Random(seed)
    return [(i, r.choice(TEXTS)) for i in range(n)] + [(3, "dup row"), (3, "dup row"), (None, "abc É"), (None, "only null"), (None, "only null")]


def key(text):
    return (text or "").translate(UPPER)


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[key(t)].append(i)
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0)])
def test_exact_dedup_also_with_colliding_digests(make, digest):
    rows, groups = pairs(), brute_groups(pairs())
    found = exact_dedup.exact_duplicates(make(rows, ["keep_id", "norm", "digest", "salt"]), digest).collect()
    largest = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = sorted(((i, largest[key(t)], len(groups[key(t)]), i == largest[key(t)]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == want


def test_exact_dedup_stage_keeps_one_row_of_each_group(make):
    rows = pairs()
    docs = make(rows, ["keep_id", "digest"])
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    want = {k: max((i for i in v if i is not None), default=None) for k, v in brute_groups(rows).items()}
    assert sorted(((r.doc_id, key(r.text)) for r in out.collect()), key=str) == sorted(((v, k) for k, v in want.items()), key=str)


def test_empty_tables(make):
    empty = make([])
    for f in (exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates, simhash.near_duplicates, simhash.drop_near_duplicates, token_counts.token_counts, byte_bpe.round_trip, line_dedup.line_dedup):
        assert f(empty).count() == 0


def slow_fingerprint(text):
    words = (text or "").translate(UPPER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(rows, radius=2):
    prints = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, prints[i], least.get(root(i))) for i, (d, _) in enumerate(rows)]


def test_simhash_equals_brute_force(make):
    r = random.Random(5)
    base = ["one two three four five six seven", "a b", "A  b", "x"]
    rows = pairs() + [(1000 + i, " ".join(r.choice(["red", "green"]) for _ in range(r.randint(4, 6)))) for i in range(150)] + [(2000 + i, t) for i, t in enumerate(base)]
    found = simhash.near_duplicates(make(rows, ["fp", "n", "key"])).collect()
    want = brute_components(rows)
    assert sorted(((x.doc_id, x.fp % 2**64, x.component_id) for x in found), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [s ^ np.uint64((1 << int(a)) | (1 << int(b))) for s in seeds for a, b in rng.integers(0, 64, (8, 2))]
    fps = np.unique(np.array([*seeds, *flips, 0, 1, 2**64 - 1], np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.fp: r.root for r in simhash.components(simhash.links(frame, bucket=bucket)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    signed = fps.view(np.int64).tolist()
    got = [found.get(x, x) for x in signed]
    assert all((got[a] == got[b]) == (label[a] == label[b]) for a in range(len(fps)) for b in range(a))


def test_tiles_find_all_pairs_and_skip_by_population_count():
    rng = np.random.default_rng(4)
    fps = np.unique(np.concatenate([x := rng.integers(0, 1 << 63, 1500, dtype=np.uint64), x[:200] ^ np.uint64(5), x[:200] ^ np.uint64(1 << 40)]))
    keys = rng.integers(0, 3, len(fps))
    tiles = simhash.Tiles(keys, fps[:, None], 2, tile=32)
    found = set()
    for i, j, near in tiles.pairs():
        found |= {frozenset((int(tiles.prints[i + a, 0]), int(tiles.prints[j + b, 0]))) for a, b in zip(*np.nonzero(near), strict=True) if tiles.keys[i + a] == tiles.keys[j + b]}
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 2) & (keys[:, None] == keys[None]) & (np.arange(len(fps))[:, None] < np.arange(len(fps))[None])
    assert found == {frozenset((int(fps[a]), int(fps[b]))) for a, b in zip(*np.nonzero(near), strict=True)} and len(found) > 100
    assert tiles.skipped > tiles.compared / 2


def test_large_buckets_are_cut_finer_without_loss():
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 14, 6000, dtype=np.uint64) << np.uint64(9))
    keys, held = simhash._finer(fps, 2, 50)
    assert np.unique(keys, return_counts=True)[1].max() < len(fps) / 2
    size = lambda a, b: len({*a.tolist(), *b.tolist()})
    whole, cut = simhash.link_forest(fps), simhash.link_forest(held, keys=keys)
    assert size(*whole) == size(*cut)


def test_forest_has_an_edge_less_than_its_members():
    fps = np.array([1 << i for i in range(64)], np.uint64)
    a, b = simhash.link_forest(fps, tile=16)
    assert len(a) == 63


def sentences():
    return st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n\té<s>/　"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=150, deadline=None)
@given(sentences())
def test_word_counts_equal_the_library(text):
    counter = token_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.text(text) == len(counter.model.encode(text))


def test_token_counts(make):
    rows = pairs()
    model = token_counts.load(public_tokenizers.path("piece_bpe_32k.model")).model
    found = token_counts.token_counts(make(rows, ["n_tokens"]), limit=3).collect()
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 3) for i, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def library():
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=sentences())
def test_byte_bpe_equals_the_library(library, text):
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(text)
    assert ids == library.encode_ordinary(text) and bpe.decode(ids).decode() == text


def test_every_character_is_of_the_same_class_as_in_the_library(library):
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    some = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    text = "".join(f"a{c}1 {c} " for c in some if ord(c) < 0x3400 or c.isspace() or ord(c) % 37 == 0)
    assert bpe.encode(text) == library.encode_ordinary(text)


def test_whole_pre_tokens_come_from_the_perfect_hash(library):
    bpe = byte_bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = " the of and zqxjzqxj the of zqxjzqxj"
    ids, edges = bpe.encode_all(["", text, "", text])
    assert ids.tolist() == library.encode_ordinary(text) * 2 and edges.tolist() == [0, 0, len(ids) // 2, len(ids) // 2, len(ids)]
    assert (bpe.hits, bpe.merged, len(bpe.known)) == (3, 1, 1)  # nothing of the vocabulary is remembered


def test_line_dedup_of_a_very_long_line_and_text(make):
    line = "x" * 3_000_000
    rows = [(i, f"{line}\nown {i}\n" + "s\n" * (200_000 if i == 3 else 2)) for i in range(6)]
    found = {r.doc_id: r for r in line_dedup.line_dedup(make(rows), digest=True).collect()}
    assert [found[i].n_dropped for i in range(6)] == [1, 1, 1, 1, 1, 0] and found[3].n_lines == 200_003
    assert found[3].kept_sha256 == hashlib.sha256(b"own 3\n" + b"s\n" * 200_000).hexdigest()


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = [str(i).encode() for i in range(3000)]
    h = byte_bpe.PerfectHash(keys)
    assert [h.index(k) for k in keys] == list(range(3000)) and sorted(h.at) == list(range(3000))
    assert h.index(b"x") == -1


def test_byte_bpe_queries(make, library):
    rows = pairs()
    docs = make(rows, ["ids", "bytes"])
    coded = byte_bpe.encode(docs)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(coded).collect()), key=str) == sorted(((i, (t or "").encode()) for i, t in rows), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x := library.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, byte_bpe.round_trip(docs).collect()), key=str) == sorted(want, key=str)


def brute_lines(rows, min_chars, min_docs):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    ids = lambda i: -(1 << 63) if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[strip(line)].add(ids(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(strip(x)) >= min_chars and len(holders[strip(x)]) >= min_docs and ids(i) != max(holders[strip(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_line_dedup_equals_brute_force(spark, make, partitions):
    r = random.Random(7)
    lines = [f"line {x} " + "é" * x for x in range(12)] + ["", "  LINE 3 ééé\t", "hot line of all the documents"]
    rows = [(r.randint(0, 70), "\n".join(r.choice([*lines, lines[-1], lines[-1]]) for _ in range(r.randint(0, 9)))) for _ in range(150)]
    rows += [(None, None), (None, lines[-1]), (5, ""), (6, lines[-1]), (6, lines[-1])]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = line_dedup.line_dedup(make(rows, ["row", "drops", "at"]), 8, 5, digest=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in found), key=str) == sorted(brute_lines(rows, 8, 5), key=str)
    for x in found:  # the bitmap alone gives the text that stays
        assert (x.keep_bitmap is None) == (x.n_dropped == 0)
        of = [t for i, t in rows if i == x.doc_id and len((t or "").split("\n")) == x.n_lines]
        assert x.kept_sha256 in {hashlib.sha256(line_dedup.kept_lines((t or "").encode(), x.keep_bitmap)).hexdigest() for t in of}
