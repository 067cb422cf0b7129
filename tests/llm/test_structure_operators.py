"""Decontamination, conversation repair and the Merkle manifest, against plain Python on odd and large tables."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from runwarden.llm import conversations, decontamination, merkle

# -- decontamination -----------------------------------------------------------------------
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = ["alpha", "b", "été", "x1", "7", "the", "the", "the", "straße", "日本"]


def tokens(text):
    return TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def item_windows(words):
    if not words:
        return []
    n = min(len(words), 10)
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def hits_of(text, benchmark):
    words = tokens(text)
    hit, items = set(), set()
    for item, body in benchmark:
        for window in item_windows(tokens(body)):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    if item is not None:
                        items.add(str(item))
    return len(words), len(hit), sorted(items)


def leak_tables():
    pick = random.Random(5)

    def prose(n):
        return [pick.choice(VOCABULARY) + (str(pick.randrange(30)) if pick.random() < 0.6 else "") for _ in range(n)]

    bodies = [prose(30) for _ in range(6)] + [prose(10), prose(9), prose(4), prose(2), ["Lone"], ["the"] * 14, bodies_same := prose(25)]
    benchmark = [(i, " ".join(b)) for i, b in enumerate(bodies)]
    benchmark += [(100, " ".join(bodies_same)), (101, None), (102, ""), (103, "--- !"), (None, " ".join(bodies[0][:12])), (0, "second text of item zero which is longer than ten words all in all")]
    texts = [" ".join(prose(40)) for _ in range(20)]
    for body in bodies:
        texts.append(" ".join(prose(15) + body + prose(15)).upper())
        texts.append("; ".join(prose(3) + body[1:] + prose(3)))
        texts.append(" ".join(body[:9] + ["other"] + body[9:]))
    texts += [None, "", "?!", "lone", " ".join(["the"] * 500), " ".join(bodies[2] + bodies[2] + bodies[3][:15])]
    texts += [" ".join(prose(20000) + bodies[1] + prose(20000))]
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)]
    hot = " ".join(bodies[4])
    rows += [(500 + i % 3, hot, "n", 1) for i in range(60)] + [(None, hot, None, None), (None, None, None, None), (3, hot, "n", 2)]
    return rows, benchmark


@pytest.fixture(scope="module")
def leaks(spark):
    rows, benchmark = leak_tables()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string, window int")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    return rows, benchmark, docs, items


def found_rows(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["item_ids"]) for r in df.collect())


def wanted_rows(rows, benchmark):
    told = {t: hits_of(t, benchmark) for t in {r[1] for r in rows}}
    return sorted((i is not None, i or 0, *told[t]) for i, t, *_ in rows)


@pytest.mark.parametrize("held", [10**6, 0])
def test_every_window_is_found(leaks, monkeypatch, held):
    rows, benchmark, docs, items = leaks
    monkeypatch.setattr(decontamination, "HELD_SHINGLES", held)
    assert found_rows(decontamination.contamination(docs, items)) == wanted_rows(rows, benchmark)


def test_digests_of_items(leaks):
    _, benchmark, docs, items = leaks
    for r in decontamination.digests(decontamination.contamination(docs.where("doc_id < 40"), items)).collect():
        ids = hits_of(dict((a, b) for a, b, *_ in leaks[0])[r["doc_id"]], benchmark)[2] if r["doc_id"] != 3 else None
        if ids is not None:
            assert (r["n_items"], r["items_sha256"]) == (len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
            assert r["contaminated"] == (r["n_hit"] > 0)


def test_without_items_or_documents(leaks):
    _, _, docs, items = leaks
    none = decontamination.contamination(docs.where("doc_id < 3"), items.where("item_id = 102")).collect()
    assert [(r["n_hit"], r["item_ids"]) for r in none] == [(0, [])] * len(none) and none
    assert decontamination.contamination(docs.limit(0), items).count() == 0


def test_no_python_in_the_plan(leaks):
    _, _, docs, items = leaks
    plan = decontamination.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- conversations -------------------------------------------------------------------------
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)

    def place(r):
        told = f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()
        return r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(told).digest()[:16]

    return sorted(out, key=place)


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) and its lines by search over (cost, audit, position, state)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(lines)
        due, then = ("assistant", 3) if state == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 2, audit + "I", at, then, (*lines, f"{due}:")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
        if faults[at] in ("blank", "duplicate"):
            continue
        more = faults[at] == "truncated"
        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, then, (*lines, f"{due}:{text}")))
        kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
        if kept:
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, kept, (*lines, f"{role}:{text}")))
    raise AssertionError


def repaired(rows):
    rows = damage(rows)
    faults = faults_of(rows)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = zip(rows[:-1], rows[1:], strict=True)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, audit, text = cheapest(rows, faults)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def talk(n_short, long_ones=()):
    pick, rows = random.Random(9), []
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "admin", "Tool", "u"]
    texts = ["Yes.", "No", "", " \n", None, "Well?\t\n", "Ü!", "end \x0b", "Twice.", "Twice."]
    for conv in range(n_short):
        for turn in range(pick.randrange(1, 9)):
            told = pick.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, told, pick.choice(roles), pick.choice(texts) if pick.random() < 0.6 else f"T{turn}."))
    for conv, n in long_ones:
        rows += [(conv, t, pick.choice(roles[:5]), pick.choice(texts) if pick.random() < 0.2 else f"T{t}.") for t in range(n)]
    rows += [(None, t, "user", "hello.") for t in range(4)] + [(None, None, None, None)]
    return rows


def compare(spark, rows):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    found = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(table).collect()}
    assert set(found) == set(groups)
    for conv, group in groups.items():
        assert found[conv] == repaired(group), (conv, group)


def test_short_conversations(spark):
    compare(spark, talk(400))


def test_long_ones_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", 7)
    compare(spark, talk(20, [(1000, 300), (1001, 50), (1002, 15)]))


def test_all_rows_lost_and_empty_table(spark):
    turn = next(t for t in range(10000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    compare(spark, [(5, turn, "user", "gone."), (6, 1, "user", "x")])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(empty).count() == 0


def test_ranks_equal_all_paths():
    pick = random.Random(3)
    for _ in range(200):
        kinds = [np.array([pick.randrange(12) for _ in range(pick.randrange(1, 9))]) for _ in range(3)]
        costs, first = conversations.costs_to_go(kinds, np.tile(conversations._END, (3, 1)))
        to = conversations._cheapest(kinds, costs, first, True)
        audits, ends = conversations.least_paths(to, first * 4)

        def every(node, to=to):
            if (to[node] < 0).all():
                return [""]
            return [c + rest for i, c in enumerate("DIKR") if to[node, i] >= 0 for rest in every(to[node, i])]

        assert [a.decode() for a in audits] == [min(every(f * 4)) for f in first]
        assert (ends // 4 == first + [len(k) for k in kinds]).all()


def test_a_very_long_text_and_turn_count(spark):
    long = "word " * 400_000 + "end."
    compare(spark, [(1, 0, "system", "s."), (1, 1, "user", long), (1, 2, "assistant", long), (1, 3, "user", long)])


# -- Merkle manifest -----------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    parts = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def build(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
    return levels


def path_in(levels, index, arity):
    out = []
    for now in levels[:-1]:
        run = index - index % arity
        out.append((now[run:index], now[index + 1 : run + arity]))
        index //= arity
    return out


def plain_manifest(rows, arity=8):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = build([leaf_of(r) for r in by_lang[lang]], arity)
    top = build([trees[x][-1][0] for x in langs], arity)
    for k, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            steps = path_in(trees[lang], i, arity) + path_in(top, k, arity)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            now = leaf_of(row, lower=changed)
            for left, right in steps:
                now = sha("".join(left) + now + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in steps))
            root = top[-1][0]
            out.append((row[0], leaf_of(row), trees[lang][-1][0], root, proof, now, now == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def manifest_rows(n, langs):
    pick = random.Random(n)
    rows = [(i, f"Text {i} É" if i % 7 else None, pick.choice(langs), f"s{i % 3}", i if i % 5 else None) for i in range(n)]
    rows += [rows[0]] * 20 + [(None, "x", None, None, None), (None, "Y", None, None, None), (1, "other", rows[1][2], None, 3)] if n > 1 else []
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    ("n", "langs", "arity"),
    [(700, ["en", "en", "en", "de", None, ""], 8), (300, [f"l{i}" for i in range(90)], 8), (100, ["a", "b"], 2), (9, ["z"], 8), (1, ["z"], 8)],
)
def test_manifest(spark, n, langs, arity):
    rows = manifest_rows(n, langs)
    schema = "doc_id long, text string, lang string, source string, n_chars long, idx string, digest int, grp string"
    docs = spark.createDataFrame([(*r, "i", 1, "g") for r in rows], schema)
    found = merkle.verified(merkle.manifest(docs, arity)).collect()
    assert order(map(tuple, found)) == order(plain_manifest(rows, arity))


def test_manifest_of_nothing_and_of_a_long_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.verified(merkle.manifest(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, "A" * 3_000_000, "en", "s", 3), (2, "b", "en", "s", 1)]
    found = merkle.verified(merkle.manifest(spark.createDataFrame(rows, schema))).collect()
    assert order(map(tuple, found)) == order(plain_manifest(rows))
