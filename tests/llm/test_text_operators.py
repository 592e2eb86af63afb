"""Operators over texts against brute force, on awkward fixtures: nulls, empties, repeats, ties, clashing columns, long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import ASCII, LOWER, SPACE, contaminated, near_classes, removed
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardpulse.llm import contamination as con
from cardpulse.llm import neardup, sketch, textkit
from cardpulse.llm.contamination import contamination, matches
from cardpulse.llm.neardup import near_duplicates
from cardpulse.llm.store import Workspace, components, without
from cardpulse.llm.substrings import remove_repeats

SCHEMA = "doc_id long, text string, component_id string, kept int, uid long, n_words string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 7, 1, "y") for i, t in rows], SCHEMA)


def corpus(seed=0, n=60):
    """Originals, exact copies, near copies by word edits, shared passages, empties and a long text."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Ünï", "日本語", "é", "A,B"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    hub = [rng.choice(words) for _ in range(100)]
    for k in range(20):
        docs.append(docs[k])
        edited = list(hub)
        for _ in range(k % 9):
            edited[rng.randrange(len(edited))] = f"edit{k}{rng.random()}"
        docs.append(" ".join(edited))
        w = docs[k + 20].split()
        w[len(w) // 2 : len(w) // 2] = passage.split()
        docs.append("\t".join(w) if k % 2 else "\n".join(w).upper())
    docs += ["", "   ", None, "one", "one two", "ONE two", "one  two three", " ".join(words * 12)]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abAB1 \t\n\x0b\x0c\r.,\x00\x1c\xa0éß日🙂"), max_size=30)), max_size=8))
def test_words(texts):
    for kind, pattern in (("space", SPACE), ("ascii", ASCII)):
        seen, expected = [], []
        for a, b, w in textkit.each_words(pa.array(texts, pa.string()), kind, True, most=16):
            for i in range(b - a):
                seen.append([w.data[x:y].tobytes().decode() for x, y in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)])
            assert len(set(w.hash.tolist())) == len({w.data[x:y].tobytes() for x, y in zip(w.start, w.end, strict=True)})
        expected = [pattern.findall((t or "").translate(LOWER)) for t in texts]
        assert seen == expected


@pytest.mark.parametrize("size", [1, 2, 3, 13, 50])
def test_windows_tell_sequences_apart(size):
    rng = np.random.default_rng(size)
    words = textkit.mix(rng.integers(0, 3, 400).astype(np.uint64))
    found = textkit.windows(words, size)
    assert len(np.unique(found)) == len({tuple(words[k : k + size].tolist()) for k in range(len(words) - size + 1)})
    assert len(textkit.windows(words[: size - 1], size)) == 0


def test_sketch_never_falls_short():
    keys = textkit.mix(np.arange(5000, dtype=np.uint64))
    gathered = sketch.Gathered(sketch.LEAST)
    for part in (keys[:3000], keys[2000:], keys[:10]):
        gathered.add(part)
    blocks = pa.RecordBatch.from_arrays(gathered.blocks(), names=["block", "ones", "twos"])
    bitmap = np.zeros(sketch.ROWS * sketch.LEAST // 8, np.uint8)
    for out in sketch._sum_blocks(iter([blocks])):
        for b, bits in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            bitmap[b * sketch.BLOCK // 8 : (b + 1) * sketch.BLOCK // 8] = np.frombuffer(bits, np.uint8)
    hit = sketch.repeated(bitmap, keys)
    assert hit[:10].all()
    assert hit[2000:3000].all()
    assert hit.sum() < 1200


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 128), (5, 80, 4)])
def test_near_duplicates(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # small blocks send the group of edits through the way of large groups
    rows = corpus()
    expected = near_classes(rows, size, percent)
    got = near_duplicates(frame(spark, rows).repartition(3), size, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    out = {r["doc_id"]: r for r in got.collect()}
    assert {i: r["component_id"] for i, r in out.items()} == expected
    assert all(r["kept"] == (i == expected[i]) for i, r in out.items())
    assert sum(i != c for i, c in expected.items()) > 25


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "x y z q"), (2, "X Y Z Q"), (3, "A b c d"), (None, "a b c d"), (None, None), (4, None), (5, ""), (6, "a"), (7, "A")]
    out = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"]} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert [r["n_shingles"] for r in out if r["doc_id"] in (4, 5)] == [0, 0]
    assert near_duplicates(frame(spark, rows).where("false")).count() == 0


def template_pages(n, seed, copies=0):
    """Texts that share half of their words, in one place, with a template; none a duplicate but for the near copies at the end."""
    rng = random.Random(seed)
    common = " ".join(f"t{k}" for k in range(60))
    own = [[f"u{rng.getrandbits(40)}" for _ in range(60)] for _ in range(n)]
    near = [[*own[k][:-1], "edited"] for k in range(copies)]
    return [(k, f"{common} {' '.join(w)}") for k, w in enumerate(own + near)]


@pytest.mark.parametrize("copies", [0, 40])
def test_pages_of_one_template_are_not_compared_with_one_another(spark, monkeypatch, copies):
    """All share bands with one another; what is compared in the end grows with the duplicates, not with the square of the pages."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    compared, dealt = [], neardup.dealt

    def seen(df, key, size):
        compared.append(df.count())
        return dealt(df, key, size)

    monkeypatch.setattr(neardup, "dealt", seen)
    rows = template_pages(600, 3, copies)
    sets = [neardup.shingle_sets(w, 1, 3)[0] for _, t in rows[:40] for _, _, w in textkit.each_words(pa.array([t]), "space", True)]
    keys = neardup.band_keys(neardup.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]))
    assert (keys[:, None, :] == keys[None, :, :]).any(axis=2).mean() > 0.3  # they do meet in bands
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert out == {k: k if k < 600 else k - 600 for k in range(600 + copies)}
    assert compared == [2 * copies]


def test_prefixes_of_linked_sets_meet():
    rng = random.Random(12)
    for percent in (80, 85):
        for _ in range(400):
            both = [rng.getrandbits(63) for _ in range(rng.randint(1, 60))]
            one, two = ({*both, *(rng.getrandbits(63) for _ in range(rng.randint(0, 12)))} for _ in range(2))
            often = np.array(rng.sample(both, rng.randint(0, len(both))), dtype=np.uint64)
            a, b = (np.array(sorted(x), dtype=np.uint64) for x in (one, two))
            if neardup.is_link(len(one & two), len(one), len(two), percent):
                assert set(neardup.prefix(a, often, percent).tolist()) & set(neardup.prefix(b, often, percent).tolist())
    assert len(neardup.prefix(np.array([5], np.uint64), np.zeros(0, np.uint64), 85)) == 1


def test_recall_at_the_threshold():
    """Pairs that just reach 0.85 share a band, and their estimate is not below the cut: 20,000 pairs of sets of 7 to 200 shingles."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(20000):
        union = int(rng.integers(7, 201))
        shared = -(-85 * union // 100)
        all_ = rng.integers(0, 1 << 63, union).astype(np.uint64)
        half = shared + (union - shared) // 2
        sets += [np.sort(all_[:half]), np.sort(np.concatenate((all_[:shared], all_[half:])))]
    signature = neardup.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1])
    keys = neardup.band_keys(signature)
    met = (keys[0::2] == keys[1::2]).any(axis=1)
    least = 0.85 - neardup.SLACK * np.sqrt(0.85 * 0.15 / signature.shape[1])
    near = (signature[0::2] == signature[1::2]).mean(axis=1) >= least
    assert (met & near).mean() >= 0.999


def test_block_links_span_what_pairs_link():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    sets = []
    for _ in range(14):
        own = set(base)
        for _ in range(rng.randint(0, 9)):
            own.discard(rng.choice(base))
            own.add(rng.getrandbits(64))
        sets.append(np.array(sorted(own), dtype=np.uint64))
    at = np.cumsum([0, *map(len, sets)])[:-1]
    signature = neardup.signatures(np.concatenate(sets), at)
    links = neardup.block_links(list(range(14)), [False] * 14, [0] * 14, sets, signature, 80)
    forest = neardup._Forest(14)
    for a, b in links:
        assert forest.root(a) != forest.root(b)
        forest.up[forest.root(a)] = forest.root(b)
    for a in range(14):
        for b in range(a):
            if neardup.is_link(neardup.shared(sets[a], sets[b]), len(sets[a]), len(sets[b]), 80):
                assert forest.root(a) == forest.root(b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    ws = Workspace(spark, "test")
    got = {r["node"]: r["component"] for r in components(ws, spark.createDataFrame(edges, "a long, b long")).collect()}
    ws.close()
    assert got == {n: root(n) for n in up}


@pytest.mark.parametrize("size", [50, 6])
def test_substrings(spark, size):
    rows = corpus(3)
    rows += [(rows[0][0], rows[0][1]), (None, rows[1][1]), (999, rows[2][1])]  # a repeated row, a null id, one more copy
    got = remove_repeats(frame(spark, rows).repartition(4), size)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    expected = removed(rows, size)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert sum(r[2] for r in expected) > 500
    assert remove_repeats(frame(spark, rows).where("false")).count() == 0


def test_substrings_without_known_copies(spark, monkeypatch):
    from cardpulse.llm import substrings

    monkeypatch.setattr(substrings, "KNOWN_COPIES", 1)
    monkeypatch.setattr(substrings, "ROW_WINDOWS", 7)
    monkeypatch.setattr(substrings, "SENT_IDS", 0)
    rows = corpus(5)
    assert sorted(map(tuple, remove_repeats(frame(spark, rows), 20).collect()), key=str) == sorted(removed(rows, 20), key=str)


def test_prefilter_at_great_sizes(spark, monkeypatch):
    """A sketch that is full, as far beyond 30 GB, lets all keys through, but next to no window that is not repeated; the result is the same."""
    from cardpulse.llm import substrings

    rng = random.Random(6)
    passage = " ".join(f"p{rng.getrandbits(30)}" for _ in range(80))
    rows = [(k, " ".join(f"x{rng.getrandbits(30)}" for _ in range(400)) + (" " + passage if k % 10 == 0 else "")) for k in range(200)]
    passed, table = {}, substrings.Workspace.table

    def seen(ws, df):
        out = table(ws, df)
        if out.columns == ["doc_id", "text_hash", "key"]:
            passed["keys"] = out.count()
        if out.columns == ["uid", "doc_id", "windows"]:
            passed["windows"] = out.select(F.sum(F.size("windows"))).first()[0]
        return out

    monkeypatch.setattr(substrings.Workspace, "table", seen)
    monkeypatch.setattr(sketch, "repeated_bitmap", lambda blocks, width, volume: b"\xff" * (sketch.ROWS * width // 8))
    got = remove_repeats(frame(spark, rows), 50)
    assert sorted(map(tuple, got.collect())) == sorted(removed(rows, 50))
    all_windows = sum(len(t.split()) - 49 for _, t in rows)
    repeated = 20 * 31
    assert passed["keys"] > all_windows / 20  # the sketch alone filters nothing
    assert passed["windows"] - repeated < 0.05 * (all_windows - repeated)


ITEMS = [(1, "w1 w2 w3"), (10, None), (2, ""), (None, "w5 w6 w7"), (3, "W9, w8. w7"), (10, "w1 W2")]


def benchmark(rows):
    """Items cut out of documents, short ones, and one that repeats itself."""
    texts = [t.split() for _, t in rows if t and len(t.split()) > 60]
    return ITEMS + [(100 + k, " ".join(t[5 : 5 + 10 + 3 * k])) for k, t in enumerate(texts[:9])] + [(50, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]


@pytest.mark.parametrize("passes", [1, 3])
def test_contamination(spark, monkeypatch, passes):
    rows = corpus(7) + [(500, "w1 " * 40), (501, "x w1-w2-W3 y"), (None, "w1 w2")]
    items = benchmark(rows)
    if passes > 1:
        monkeypatch.setattr(con, "PASS_CHARS", sum(len(t or "") for i, t in items if i is not None) // 2)
    test = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = contamination(frame(spark, rows), test, slop=0)
    out = sorted((tuple(r)[:6] for r in got.collect()), key=str)
    assert out == sorted(contaminated(rows, items, 13, 20), key=str)
    assert sum(r[5] for r in out) > 5


def test_one_index_serves_two_benchmarks(spark, tmp_path, monkeypatch):
    """The written index holds every term, is built once and is searched for any items, also in parts."""
    rows = corpus(7)
    con.segments_of(frame(spark, rows).repartition(2)).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    words = {x for _, t in rows for x in ASCII.findall((t or "").translate(LOWER))}
    stored = {int(h) for r in index.collect() for h in np.frombuffer(r["term"], np.uint64)}
    assert len(stored) == len(words)
    monkeypatch.setattr(con, "segments_of", None)  # no search builds an index
    for chars in (1 << 22, 300):
        monkeypatch.setattr(con, "PASS_CHARS", chars)
        for items in (benchmark(rows), [(7, "w3 w4"), (8, rows[3][1])]):
            got = con.search(index, spark.createDataFrame(items, "item_id long, text string"), 13, 0)
            want = {(i, n, x) for i, n, _, x, _, _ in contaminated(rows, items, 13, 20)}
            assert {(r["doc_id"], r["n_words"], len(r["items"])) for r in got.collect()} == want


def test_long_segments(spark):
    """A text with more words than two bytes can number."""
    text = " ".join(f"a{k % 7919}" for k in range(70000))
    item = " ".join(f"a{k % 7919}" for k in range(66000, 66013))
    out = contamination(frame(spark, [(1, text), (2, "a b")]), spark.createDataFrame([(5, item)], "item_id long, text string"), 13, 20, 0)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in out.collect()) == [(1, 70000, 13 * 9), (2, 2, 0)]


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "a b"), (2, None)]
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in contamination(frame(spark, rows), none).orderBy("doc_id").collect()] == [(1, 2, 0, False), (2, 0, 0, False)]
    assert contamination(frame(spark, rows).where("false"), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu"
    rows = [(1, item), (2, item.replace("delta", "delta so")), (3, item.replace("delta", "delta so very much")), (4, " ".join(reversed(item.split())))]
    got = {r["doc_id"]: (r["items"], r["near"]) for r in matches(frame(spark, rows), spark.createDataFrame([(9, item)], "item_id long, text string"), slop=2).collect()}
    assert got == {1: (["9"], []), 2: ([], ["9"]), 3: ([], []), 4: ([], [])}


def test_matches_stay_in_their_document(spark):
    rows = [(1, "a b c"), (2, "rare a b"), (3, "c rare")]
    items = spark.createDataFrame([(9, "a b c rare")], "item_id long, text string")
    assert all(not r["items"] and not r["near"] for r in matches(frame(spark, rows).coalesce(1), items, 4).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_proximity_against_brute_force(spark, parts):
    rng, slop, size = random.Random(11), 2, 4
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))) for k in range(40)]
    items = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))) for k in range(12)]
    want = {}
    for i, t in rows:
        w, exact, near = t.split(), set(), set()
        for item, text in items:
            own = text.split()
            for window in [own[k : k + size] for k in range(max(len(own) - size, 0) + 1)]:
                for b in range(len(w)):
                    if w[b : b + len(window)] == window:
                        exact.add(str(item))
                    if w[b] == window[0] and all(any(0 <= b + k + d < len(w) and w[b + k + d] == x for d in range(-slop, slop + 1)) for k, x in enumerate(window)):
                        near.add(str(item))
        want[i] = (sorted(exact), sorted(near - exact))
    df = matches(frame(spark, rows).repartition(parts), spark.createDataFrame(items, "item_id long, text string"), size, slop)
    assert {r["doc_id"]: (r["items"], r["near"]) for r in df.collect()} == want


def test_intermediate_tables_need_a_shared_folder():
    """Without a named folder a cluster's executors would write where nobody else can read."""
    from types import SimpleNamespace as Some

    from cardpulse.llm import store

    def session(master, setting=None, chosen=None):
        folder = Some(isDefined=lambda: chosen is not None, get=lambda: chosen)
        return Some(conf=Some(get=lambda name, default: setting), sparkContext=Some(master=master, _jsc=Some(sc=lambda: Some(getCheckpointDir=lambda: folder))))

    assert store.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert store.shared_dir(session("yarn", None, "hdfs://x/ck")) == "hdfs://x/ck"
    assert store.shared_dir(session("local[4]")).startswith("file:/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError, match=r"checkpoint\.dir"):
            store.shared_dir(session(master))


def test_workspace_restores_settings_and_deletes_tables(spark):
    from pathlib import Path

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), Workspace(spark, "test") as ws:
        inner = int(str(spark.conf.get(name)).rstrip("b"))
        path = Path(ws.table(spark.range(3))._cardpulse_path.removeprefix("file://").removeprefix("file:"))
        assert path.exists()
        raise ZeroDivisionError
    assert inner <= 2 << 20
    assert spark.conf.get(name) == before
    assert not path.exists()


def test_the_driver_gives_freed_native_memory_back(spark):
    """150 MB of small buffers outside the JVM's heap, of which some stay: glibc keeps the rest when they are freed."""
    import gc
    import re
    import time
    from pathlib import Path

    java = spark._jvm.java
    rollup = Path(f"/proc/{java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not rollup.exists() or int(java.lang.Runtime.version().feature()) < 17:
        pytest.skip("needs Linux and a JVM with the command")
    pool = next(b for b in java.lang.management.ManagementFactory.getPlatformMXBeans(java.lang.Class.forName("java.lang.management.BufferPoolMXBean")) if b.getName() == "direct")

    def resident():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", rollup.read_text())[1]) / 1024

    with Workspace(spark, "test") as ws:
        ws.tidy()
        before = pool.getMemoryUsed()
        buffers = [java.nio.ByteBuffer.allocateDirect(50_000) for _ in range(3000)]
        stay = buffers[::100]
        del buffers
        end = time.time() + 30
        while pool.getMemoryUsed() > before + 10_000_000 and time.time() < end:  # buffers are freed by a thread of the JVM
            gc.collect()
            java.lang.System.gc()
            time.sleep(0.2)
        held = resident()
        ws.tidy()
        assert resident() < held - 75
    assert len(stay) == 30


def test_long_texts_are_read_whole(spark):
    """200,000 words (1.3 MB) that differ from a copy in the last ones only, beside short texts."""
    from cardpulse.llm import packing, quality, registry, toxicity

    words = [f"w{k * 7919 % 100003}" for k in range(200000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, "short text of a few words"), (4, " ".join(words[150000:150060]))]
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4}
    left = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(frame(spark, rows), 50).collect()}
    assert left == {1: (200000, 0), 2: (200000, 199999), 3: (6, 0), 4: (60, 60)}
    pieces = packing.pack(frame(spark, rows).withColumn("source", F.lit("s")), registry.tokenizer_path()).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == 1) > 200000
    texts = pa.array([rows[0][1], "w1 w2"])
    number = np.zeros(quality.BUCKETS, np.float32)
    number[quality._bucket(textkit.Words(*textkit.column_bytes(pa.array([words[-1]])), textkit.separators("space"), False).hash, 1)] = 1
    assert quality.logits(texts, number, 0.0)[0] > 0  # the last word counts
    weight = np.zeros(toxicity.BUCKETS, np.float32)
    weight[toxicity._bucket(toxicity._words([words[-1]]).hash, 0)] = 1
    assert toxicity.logits(texts, weight, 0.0)[0] >= 1


def test_without(spark, monkeypatch):
    from cardpulse.llm import store

    docs, gone = frame(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d")]), spark.createDataFrame([(2,), (None,), (5,)], "doc_id long")
    for bound in (store.SENT_IDS, 0):
        monkeypatch.setattr(store, "SENT_IDS", bound)
        out = without(docs, gone)
        assert out.columns == docs.columns
        assert sorted(r["text"] for r in out.collect()) == ["a", "d"]
    assert F is not None
