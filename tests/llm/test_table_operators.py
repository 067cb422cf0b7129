"""Operators that compare rows, against brute force on small tables with odd rows and a hot group."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from runwarden.llm import candidates, fingerprints, graph, minhash, oddsketch, packing, queries, repeats, vectors, warc

WORDS = ["".join(random.Random(i).choice("abcdefghij") for _ in range(6)) for i in range(400)]


def prose(seed, n):
    pick = random.Random(seed)
    return [pick.choice(WORDS) for _ in range(n)]


def edited(words, seed, changes):
    pick, words = random.Random(seed), list(words)
    for _ in range(changes):
        words[pick.randrange(len(words))] = f"new{pick.random():.6f}"
    return words


def corpus():
    """(doc_id, text, text2, id): unrelated texts, near copies, a hot group, shared passages and odd rows."""
    rows, passage = [], prose(77, 60)
    for i in range(40):
        rows.append(prose(i, 20 + 5 * i))
    base = prose(500, 120)
    rows += [edited(base, i, i % 6) for i in range(60)]
    rows += [prose(501, 80)] * 50
    rows += [prose(600 + i, 30) + passage + prose(700 + i, 30) for i in range(10)]
    rows += [prose(800, 300) + ["gap"] + prose(800, 300)]
    texts = [" ".join(r) for r in rows] + [None, "", " \n", "one", "ONE", "one two", "İ é", "\t".join(prose(5, 45)).upper()]
    out = [(i, t, "other", i) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[5], None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, n_words string, id int")


def components(ids, linked):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingle_set(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_components(width):
    sets = {i: shingle_set(t, width) for i, t, *_ in corpus() if i is not None}
    ids = sorted(sets)
    linked = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return sets, components(ids, linked)


@pytest.mark.parametrize("width", [2, 5])
def test_odd_sketch_components(docs, width):
    sets, expected = near_components(width)
    rows = oddsketch.near_duplicates(docs, width=width).collect()
    assert len(rows) == len(corpus())
    for row in rows:
        if row.id is None:
            assert not row.kept
            continue
        assert (row.n_shingles, row.component_id) == (len(sets[row.id]), expected[row.id])
        assert row.kept == (row.id == row.component_id)


def test_odd_sketch_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 4)
    _, expected = near_components(2)
    assert all(r.component_id == expected[r.id] for r in oddsketch.near_duplicates(docs, width=2).collect() if r.id is not None)


def test_odd_sketch_of_nothing(docs):
    assert oddsketch.near_duplicates(docs.limit(0)).count() == 0


def test_odd_sketch_estimates():
    random_ = np.random.default_rng(2)
    one = random_.integers(0, 1 << 32, (1, 240), dtype=np.uint64).astype(np.uint32)
    for share in (1.0, 0.95, 0.9, 0.8):
        many = np.repeat(one, 300, 0)
        flip = random_.random(many.shape) >= share
        many[flip] = random_.integers(0, 1 << 32, int(flip.sum()), dtype=np.uint64)
        found = oddsketch.estimate(oddsketch.sketches(one)[0], oddsketch.sketches(many), 240)
        assert abs(found.mean() - share) < 0.02


def pairs_near_the_limit(count, size, seed):
    """Hashes and bounds of sets, two after each other of likeness 0.80 to 0.82."""
    random_ = np.random.default_rng(seed)
    sets = []
    for _ in range(count):
        union = random_.integers(0, 1 << 63, size, dtype=np.uint64)
        alone = size - random_.integers(-(-80 * size // 100), 82 * size // 100 + 1)
        cut = random_.integers(0, alone + 1)
        sets += [union[cut:], np.concatenate((union[:cut], union[alone:]))]
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(list(map(len, sets)))))


@pytest.mark.parametrize("size", [50, 100, 400])
def test_recall_near_the_limit(size):
    """Every one of 3,000 pairs shares a band and has an estimate that is confirmed, in both operators."""
    hashes, first = pairs_near_the_limit(3000, size, size)
    signature = minhash.signatures(hashes, first, oddsketch.ROWS * oddsketch.BANDS, oddsketch._SEED)
    sketch = oddsketch.sketches(signature)
    found = oddsketch.estimate(sketch[::2], sketch[1::2], signature.shape[1])
    band = np.all([signature[::2, k :: oddsketch.ROWS] == signature[1::2, k :: oddsketch.ROWS] for k in range(oddsketch.ROWS)], axis=0)
    assert ((found >= oddsketch.LEAST_ESTIMATE) & band.any(1)).mean() > 0.999
    sketch = fingerprints.sketches(hashes, first)
    found = fingerprints.likeness(sketch[::2], sketch[1::2])
    same = (sketch[::2] == sketch[1::2]).reshape(3000, fingerprints.BANDS, fingerprints.ROWS).all(2)
    assert ((found >= fingerprints.LEAST_ESTIMATE) & same.any(1)).mean() > 0.999


def test_fingerprint_classes(docs):
    _, expected = near_components(5)
    every = fingerprints.near_duplicates(docs, least_estimate=0).collect()
    assert all(r.component_id == expected[r.id] for r in every if r.id is not None)


def test_fingerprint_classes_by_estimate(docs):
    _, expected = near_components(5)
    found = [r for r in fingerprints.near_duplicates(docs).collect() if r.id is not None]
    assert all(r.component_id == expected[r.id] for r in found)


def test_fingerprints_compare_with_the_next(docs):
    rows = fingerprints.compared_with_next(docs).collect()
    texts = {i: t or "" for i, t, *_ in corpus() if i is not None}
    assert len(rows) == len(corpus())
    ids = sorted(texts, reverse=True)
    by_text = {}
    for row in rows:
        if row.doc_id in (None, 0, 3):
            continue
        own, following = texts[row.doc_id], texts[ids[ids.index(row.doc_id) + 1]]
        new = own[: len(own) - len(own) // 3] + following[: len(own) // 3]
        assert (row.n_chars, row.edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert by_text.setdefault(own, row.fingerprint) == row.fingerprint
        for other, near in ((new, row.near_edited), (following, row.near_next)):
            one, two = shingle_set(own, 5), shingle_set(other, 5)
            exact = len(one & two) / len(one | two) if one | two else 1.0
            assert abs(exact - near) < 0.16
    _, expected = near_components(5)
    classed = fingerprints.compared_with_next(docs, classes=fingerprints.near_duplicates(docs)).collect()
    assert sorted(map(repr, (r[:-1] for r in classed))) == sorted(map(repr, map(tuple, rows)))
    assert all(r.component_id == expected.get(r.doc_id) for r in classed)
    one = fingerprints.compared_with_next(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.compared_with_next(docs.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [1 << 22, 600])
def test_repeats(docs, monkeypatch, batch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    monkeypatch.setattr(repeats, "ENTRIES_PER_GROUP", 3000)
    lists = [(i, (t or "").encode().split()) for i, t, *_ in corpus()]
    seen = {}
    for n, (_, words) in enumerate(lists):
        for k in range(len(words) - 34):
            seen.setdefault(tuple(words[k : k + 35]), []).append((n, k))
    gone = [set() for _ in lists]
    for places in seen.values():
        if len(places) > 1:
            for n, k in places:
                gone[n].update(range(k, k + 35))
    expected = sorted(
        (i if i is not None else -1, len(w), len(gone[n]), " ".join(x.decode() for k, x in enumerate(w) if k not in gone[n]))
        for n, (i, w) in enumerate(lists)
    )
    found = repeats.remove_repeats(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text) for r in found) == expected
    for row in found:
        spans = list(zip(row.repeats[::2], row.repeats[1::2], strict=True))
        assert sum(b - a for a, b in spans) == row.n_removed and all(b - a >= 35 for a, b in spans)
    assert found[0].asDict().keys() >= {"id", "doc_id", "text"}


def test_repeats_of_nothing(docs):
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    assert [r.n_removed for r in repeats.remove_repeats(docs.where("doc_id = 1")).collect()] == [0]


def test_components_of_chains_and_stars(spark):
    pick = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5)]
    links += [(pick.randint(2000, 2100), pick.randint(2000, 2100)) for _ in range(60)]
    expected = components({x for pair in links for x in pair}, links)
    found = {r.id: r.component_id for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: c for i, c in expected.items() if i != 5}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows():
    random_ = np.random.default_rng(3)
    rows = [(i, random_.standard_normal(16).tolist(), i % 2) for i in range(60)]
    center = random_.standard_normal(16)
    rows += [(100 + i, (center + random_.standard_normal(16) * 0.13).tolist(), 1) for i in range(80)]
    rows += [(200 + i, center.tolist(), 1) for i in range(40)] + [(300, center.tolist(), None), (301, center.tolist(), 0)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None, *[1.0] * 15], 1)]
    rows += [(404, [float("inf")] * 16, 1), (405, [1e30 * x for x in center.tolist()], 1), (406, [1.0], 1), (407, [2.0], 1), (408, [], 1)]
    return [*rows, rows[0], (None, rows[1][1], 1)]


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def near(a, b):
        if a[2] is None or a[2] != b[2] or not usable(a[1]) or not usable(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]) / max(map(abs, a[1])), np.array(b[1]) / max(map(abs, b[1]))
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    known = [r for r in rows if r[0] is not None]
    linked = [(a[0], b[0]) for i, a in enumerate(known) for b in known[i + 1 :] if near(a, b)]
    count = {r[0]: 0 for r in known}
    for a, b in linked:
        count[a] += 1
        if a != b:
            count[b] += 1
    count[1] += 1  # the row without vec_id
    expected = components(set(count), linked)
    found = vectors.near_duplicates(table).collect()
    assert len(found) == len(rows)
    for row in found:
        if row.vec_id is not None:
            assert (row.n_links, row.component_id) == (count[row.vec_id], expected[row.vec_id]), row
            assert row.kept == (row.vec_id == row.component_id)
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def page_rows():
    rows = [(i, f"http://x/{i}", f"<p>page {i % 7} " + "é" * 100) for i in range(40)]
    rows += [(100 + i, None, "short") for i in range(4)] + [(200, "u\r\nX: y", None), (201, "u", ""), (202, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    return [*rows, rows[0], rows[0], (0, "http://other", rows[0][2]), (None, "n", rows[1][2])]


def test_warc_round_trip(spark):
    rows = page_rows()
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), archive_bytes=4000)
    assert archives.files.count() > 1
    found = warc.with_payload(warc.read(archives.index, archives.files, near_bytes=0, read_bytes=3000)).collect()
    least = {}
    for page, _, text in rows:
        if page is not None and len((text or "").encode()) >= 100:
            least[text] = min(page, least.get(text, page))
    expected = sorted(
        (
            page if page is not None else -1,
            "".join(c for c in url or "" if c >= " "),
            hashlib.sha256((text or "").encode()).hexdigest(),
            len((text or "").encode()),
            least.get(text) if least.get(text, page) != page else None,
            text or "",
        )
        for page, url, text in rows
    )
    assert expected == sorted(
        (r.page_id if r.page_id is not None else -1, r.url, r.payload_digest, r.payload_bytes, r.refers_to, r.payload) for r in found
    )
    assert all(r.intact and (r.record_type == "revisit") == (r.refers_to is not None) for r in found)
    some = warc.read(archives.index.where("page_id between 5 and 20"), archives.files).collect()
    assert {r.page_id for r in some} == set(range(5, 21))
    assert warc.read(archives.index.limit(0), archives.files).count() == 0


def test_warc_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write(empty)
    assert warc.read(archives.index, archives.files).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, " ".join(prose(900 + i, 60)), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, rows[0][1] + f" tail{i}", "en", "s", 1) for i in range(5)]
    shared = " ".join(prose(950, 50))
    rows += [(200 + i, " ".join(prose(960 + i, 40)) + " " + shared, "en", "s", 1) for i in range(3)]
    rows += [(300 + i, " ".join(prose(970 + i, 30)) + " idiot moron", "en", "s", 1) for i in range(20)]
    rows += [(400, " ".join(prose(990, 30)) + " password=hunter2hunter2", "en", "s", 1), (401, None, None, None, None), (None, "x", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int(300 <= (r[0] or 0) < 400)) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, after = kept.columns, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, str(tmp_path))
        assert kept.columns == columns
        after[name] = {r.doc_id: r.text for r in kept.collect()}
    clean = {r[0] for r in rows if not 300 <= (r[0] or 0) < 400}
    assert set(after["toxicity"]) == clean
    assert set(after["near_duplicates"]) == clean - {100 + i for i in range(5)}
    assert after["repeats"].keys() == after["near_duplicates"].keys()
    assert all(after["repeats"][200 + i] == " ".join(prose(960 + i, 40)) for i in range(3))
    assert after["repeats"][1] == rows[1][1]
    assert after["secrets"][400].endswith(" [SECRET]") and after["secrets"][401] is None
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    assert set(packed["doc_id"].dropna()) == set(after["secrets"]) - {None}


def test_registered_names():
    import __spark_entry__ as contract

    names = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())
