"""The operators against brute force, on a small table with every awkward case."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from quarry.llm import bpe, edits, jaccard, maxent, mixing, neighbours, quality, quotes, repeats, scratch, sharding
from quarry.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n long, block int, label int"


def corpus():
    rng = random.Random(5)
    syllables = ["ta", "ri", "Son", "é", "ü", "ka", "lo", "mi", "ß", "中"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + ("\n" if rng.random() < 0.05 else "") for _ in range(n))
    passage = prose(60)
    texts = [None, "", "   \n\t ", "one", "two words", "ha " * 400, "x" * 3000, "a b c d", "a b c d e", "A B C D E", "a b " * 30, "#$ " * 50]
    texts += [prose(rng.randint(5, 120)) for _ in range(40)]
    texts += [prose(20) + " " + passage + " " + prose(15) for _ in range(12)]
    texts += [texts[15]] * 30
    base = prose(150).split(" ")
    for _ in range(60):  # near copies
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [prose(6000)]
    rng.shuffle(texts)
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}", 0, 1, 2, 3, 4) for i, t in enumerate(texts)]


ROWS = corpus()
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def enc():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sets_and_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [jaccard.HOT, 3])
def test_jaccard(docs, hot):
    sets, parts = sets_and_components(TEXT)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, hot=hot).collect()}
    assert got == {i: (len(sets[i]), parts[i]) for i in TEXT}


@pytest.mark.parametrize("wide", [{}, {"hot": 2, "local": 3}, {"local": 2}])
def test_suffix_dedup(docs, wide):
    seen = set()
    got = {r["doc_id"]: r for r in repeats.remove(docs, repeats.repeated_spans(docs, **wide)).collect()}
    for i in sorted(TEXT):
        raw = TEXT[i].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if (w := raw[k : k + 100]) in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        spans = len([x for x in bytes(gone).replace(b"\0", b" ").split() if x])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_repeat_groups(docs):
    """All occurrences of a group hold the same string, later ones are what is removed, and trees' groups have two or more."""
    groups, later = defaultdict(set), set()
    for r in repeats.repeat_groups(docs).collect():
        raw = TEXT[r["doc_id"]].encode()[r["start"] : r["end"]]
        assert len(raw) == r["end"] - r["start"] >= 100
        groups[r["path"], r["repeat"]].add((r["doc_id"], r["start"], raw))
    for (path, _), found in groups.items():
        assert len({raw for _, _, raw in found}) == 1
        first = min((i, a) for i, a, _ in found) if path == 1 else None
        assert path != 1 or len(found) > 1
        later |= {(i, a + k) for i, a, raw in found if (i, a) != first for k in range(len(raw))}
    spans = {(r["doc_id"], k) for r in repeats.repeated_spans(docs).collect() for k in range(r["start"], r["end"])}
    assert later == spans


def test_long_documents_are_cut_in_parts(spark, monkeypatch):
    rng = random.Random(1)
    own = "".join(rng.choices("abcdefgh ", k=9000))
    texts = [own, "x" * 50 + own[1000:7000] + "y" * 70, own[:5000] + own[:5000]]
    monkeypatch.setattr(repeats, "PART", 1500)
    monkeypatch.setattr(tx, "STEP", 1000)
    bufs = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    for i, a, off in repeats._parts(np.array([0, *np.cumsum([len(b) for b in bufs])]), 100):
        assert off[-1] <= 1500 + 99 or len(off) > 2
    windows = sum(c.sum() for i, a, off in repeats._parts(np.array([0, 9000]), 100) for _, c, _, _ in [repeats.pieces(bufs[0][a : a + off[-1]], off)])
    assert windows == 9000 - 99


def test_intervals_give_maximal_repeats():
    raw = np.frombuffer(b"xabcdeyabcdezabcd", np.uint8)
    found = {(n, tuple(sorted(p.tolist()))) for n, p in repeats.repeats(raw, np.array([0]), np.array([len(raw)]), np.array([0]), 4)}
    assert found == {(5, (1, 7)), (4, (1, 7, 13))}


def test_sharding(spark, docs):
    got = sharding.op3_vector_packing(docs).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(TEXT[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(TEXT[r["doc_id"]].encode()) and r["grown_shard"] is None and r["law"] == "bytes"
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    rng = random.Random(2)
    sizes = [rng.choice((30, 200, 900, 4000)) + rng.randint(0, 50) for _ in range(3000)]
    many = spark.createDataFrame([(i, "ab " * (n // 3) + str(i) if i % 5 else "one text that is often there") for i, n in enumerate(sizes)], "doc_id long, text string")
    loads = defaultdict(lambda: [0, 0, 0])
    for r in sharding.shard(many).collect():
        for k, x in enumerate((r["size"], r["tokens"], 1)):
            loads[r["shard"]][k] += x
    for k, near in ((0, 0.002), (1, 0.1), (2, 0.25)):
        own = [x[k] for x in loads.values()]
        assert len(own) == 24 and max(own) - min(own) <= near * sum(own) / 24 + 1
    place = sharding.pack_vectors(np.random.default_rng(0).random((500, 3)) * 100, 24)
    assert len(set(place)) == 24


def test_maxent(docs):
    tokens = {i: [*WORD.findall(t.translate(LOW)), None] for i, t in TEXT.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in TEXT}
    c = Counter(w for i in TEXT if not out[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for head in (maxent.HEAD, 5):
        for r in maxent.score(docs, head=head, rounds=2).collect():
            own = tokens[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(own), sum(c[w] > 0 for w in own), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)


def test_maxent_scores_and_adds_up(spark, docs):
    """Scores against a plain product of the two softmaxes and the counts; all tokens after a context add up to 1."""
    known = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
    counts = maxent.word_counts(known.select("text"))
    m = maxent.train(known, counts, rows=1 << 12)
    assert len(m.progress) == maxent.ROUNDS and np.abs(m.weights1).max() > 0 and np.abs(m.weights2).max() > 0
    n = {r["word"] & (2**64 - 1): (r["class"], r["n"]) for r in counts.collect()}
    slot = dict(zip(m.words.tolist(), m.slots.tolist(), strict=True))
    rest, once = Counter(), Counter()
    for w, (k, x) in n.items():
        if w not in slot:
            rest[k] += x
            once[k] += x == 1

    def probability(w, k, one, two):
        soft = lambda prior, weights, rows: (lambda e: e / e.sum())(np.exp(prior.astype(float) + sum(weights[r].astype(float) for r in rows)))
        p = soft(m.prior1, m.weights1, one)[k] * soft(m.prior2[k], m.weights2, two)[slot[w] % maxent.MEMBERS if w in slot else maxent.MEMBERS - 1]
        return p if w in slot else p * (n[w][1] if w in n else once[k] + 1) / (rest[k] + once[k] + 1)

    got = {r["doc_id"]: r["score"] for r in maxent.score(docs, model=m).collect()}
    for i, t in list(TEXT.items())[:40]:
        raw = np.frombuffer(t.encode(), np.uint8)
        h, c, to = maxent.tokens(raw, np.array([0, len(raw)]))
        one, two = maxent.features(h, c, to, len(m.weights1))
        want = sum(math.log10(probability(int(w), int(k), one[:, j], two[:, j])) for j, (w, k) in enumerate(zip(h, c, strict=True)))
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-4)
    raw = np.frombuffer(TEXT[20].encode() or b"a b c d", np.uint8)
    h, _, _ = maxent.tokens(raw, np.array([0, len(raw)]))
    before, total = h[: min(3, len(h) - 1)], 0.0
    for k in range(maxent.CLASSES):
        seq, to = np.append(before, np.uint64(1)), np.array([0, len(before) + 1])
        one, two = (x[:, -1] for x in maxent.features(seq, np.full(len(seq), k), to, len(m.weights1)))
        total += sum(probability(w, k, one, two) for w, (kk, _) in n.items() if kk == k) + (probability(-1, k, one, two) if k else 0)
    assert total == pytest.approx(1, abs=1e-4)


def test_maxent_learns(spark):
    """Each round scores documents that it hasn't seen better than the one before, and context beats counts."""
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(("san francisco", "new york", "los angeles", "it is", "there was")) for _ in range(30))
    d = spark.createDataFrame([(i, line()) for i in range(600)], "doc_id long, text string")
    m = maxent.train(d, maxent.word_counts(d.select("text")))
    assert m.progress == sorted(m.progress) and m.progress[-1] > m.progress[0] + 0.2
    got = [(r["base_score"], r["score"]) for r in maxent.score(d).where("held_out").collect()]
    assert sum(s for _, s in got) > 0.75 * sum(b for b, _ in got)


def test_frequent_words_have_a_bound(spark):
    counts = spark.range(1000).selectExpr("id as word", "cast(1 + id % 50 as long) as n")
    for most in (0, 5, 100, 999, 1000):
        got = {r["n"] for r in maxent.frequent(counts, most).collect()}
        assert maxent.frequent(counts, most).count() <= most and (not got or got == set(range(min(got), 51)))
    assert maxent.frequent(counts, 1000).count() == 1000


def test_edits(docs, enc):
    assert {r["doc_id"]: r["n_tokens"] for r in edits.op5_edit_counts(docs).collect()} == {i: len(enc.encode_ordinary(t)) for i, t in TEXT.items()}
    rng, cut = random.Random(2), regex.compile(public_tokenizers.PATTERN)
    known = bpe.pieces_of(bpe.read(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    for _ in range(300):
        some = lambda k: "".join(rng.choice("ab 1'st\n .é") for _ in range(rng.randint(0, k)))
        now = some(60)
        tree = edits.Tree(now, cut, lambda p: len(known[p]) >> 2)
        for _ in range(6):
            at, gone, new = rng.randint(0, 70), rng.randint(0, 9), some(rng.choice((9, 9, 600)))
            tree.edit(at, gone, new)
            at = min(at, len(now))
            now = now[:at] + new + now[at + gone :]
            assert (tree.text, tree.tokens[1], tree.chars[1]) == (now, len(enc.encode_ordinary(now)), len(now))
            assert "".join(cut.findall(now)) == now and [a for a, _ in tree.leaves()] == [len(p) for p in cut.findall(now)]


def test_edits_encode_what_they_touch(enc):
    """Also in text that an edit before put in: it has pieces of its own."""
    cut = regex.compile(public_tokenizers.PATTERN)
    known = bpe.pieces_of(bpe.read(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    tree = edits.Tree("some words " * 500, cut, lambda p: len(known[p]) >> 2)
    tree.edit(2000, 0, "new text of many words " * 200)
    before = tree.encoded
    tree.edit(3000, 3, "x")
    assert before > 900 and tree.encoded - before <= 6 and tree.tokens[1] == len(enc.encode_ordinary(tree.text))


def test_given_edits(spark, docs, enc):
    todo = spark.createDataFrame([(3, 1, 0, 2, "Q"), (3, 0, 1, 0, "zz "), (5, 0, 10**6, 5, "!")], "doc_id long, seq int, at int, gone int, new string")
    got = {r["doc_id"]: r["n_edited"] for r in edits.counted(docs, todo).collect()}
    t = TEXT[3][:1] + "zz " + TEXT[3][1:]
    assert got[3] == len(enc.encode_ordinary("Q" + t[2:])) and got[5] == len(enc.encode_ordinary(TEXT[5] + "!")) and got[7] == len(enc.encode_ordinary(TEXT[7]))


def test_stored_trees(spark, docs, enc, tmp_path):
    """Two tables of edits, one after the other, on a table of trees; rows without edits encode nothing."""
    edits.trees(docs).write.parquet(f"{tmp_path}/t0")
    rng, now = random.Random(9), dict(TEXT)
    for k in range(2):
        todo = []
        for i in rng.sample(sorted(now), 60):
            for seq in range(rng.randint(1, 3)):
                at, gone, new = rng.randint(0, len(now[i]) + 3), rng.randint(0, 5), rng.choice(["", "x y ", "é\n\n", " it's " * 90])
                todo.append((i, seq, at, gone, new))
                at = min(at, len(now[i]))
                now[i] = now[i][:at] + new + now[i][at + gone :]
        table = spark.createDataFrame(todo, "doc_id long, seq int, at int, gone int, new string")
        got = edits.edited(spark.read.parquet(f"{tmp_path}/t{k}"), table)
        got.write.parquet(f"{tmp_path}/t{k + 1}")
        touched = {x[0] for x in todo}
        for r in spark.read.parquet(f"{tmp_path}/t{k + 1}").collect():
            assert (r["text"] or "") == now[r["doc_id"]] and r["n_tokens"] == len(enc.encode_ordinary(now[r["doc_id"]]))
            assert r["doc_id"] in touched or r["n_reencoded"] == 0


def test_quotes(spark):
    a = "The first message says something long enough."
    rows = [(1, 0, "user", a, 0), (1, 1, "assistant", "> the FIRST message  says something long enough.\nYes, this is my answer to it.", 0), (1, 2, "user", ">> The first message says something long enough.\n> Yes, this is my answer to it.\nThanks.", 0), (2, 0, "user", a, 0), (2, 1, "user", f"> {a}\nHere it was said again.", 0), (3, 0, "user", None, 0), (3, 1, "user", "> nobody ever wrote this passage", 0), (None, 1, "user", f"> {a}", 0)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(m).collect()}
    parent = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items()}
    assert parent[1, 1] == (1, 0) and parent[1, 2] == (1, 1) and parent[2, 1] == (2, 0) and parent[3, 1] == (None, None) and parent[2, 0] == (None, None)
    assert got[1, 2]["depth"] == 2 and (got[1, 2]["root_conv"], got[1, 2]["root_turn"]) == (1, 0) and got[1, 2]["clean"] == "Thanks." and got[1, 2]["quote_level"] == 2
    order = [(r["conv_id"], r["turn"]) for r in quotes.threads(quotes.link(m)).collect()]
    assert order.index((1, 0)) < order.index((1, 1)) < order.index((1, 2))


def test_partial_quotes(spark):
    one, two, three = "The first paragraph is about apples.", "The second one is\nabout pears. They are green and sweet.", "The third is about plums,\nwhich are blue in autumn,\nand about nothing else."
    long = f"{one}\n\n{two}\n\n{three}"
    quote = lambda x: "\n".join(f"> {line}" for line in x.split("\n")) + "\nI agree with this."
    asks = [f"{one}\n\n{two}", "which are blue in autumn,\nand about nothing else.", "They are green and sweet.", "The second one is about pears.", "it says here: pears of another kind altogether"]
    rows = [(1, 0, "user", "Something else was said before all that."), (1, 1, "user", long), (1, 2, "user", "They are green and sweet.\nAnd so on.")] + [(1, 3 + k, "assistant", quote(x)) for k, x in enumerate(asks)]
    got = {r["turn"]: r["parent_turn"] for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 1, 4: 1, 5: 1, 6: 1, 7: None}


def test_quotes_by_brute_force(spark):
    """Thousands of quotes of wholes, paragraphs and sentences, one passage that a third of all messages quote, nested levels."""
    rng = random.Random(12)
    sentence = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(3, 8))).capitalize() + "."
    said, rows = [], []
    for n in range(1500):
        conv, turn = n % 40, n // 40
        own = "\n\n".join(" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
        quoted = ""
        if said and rng.random() < 0.85:
            full = said[0] if rng.random() < 0.4 else rng.choice(said[-200:])
            part = rng.choice([full, *full.split("\n\n"), *full.replace("\n\n", " ").split(". ")])
            mark = rng.choice(["> ", ">> ", "> > "])
            quoted = "\n".join(mark + x for x in part.split("\n")) + "\n"
        said.append(own)
        rows.append((conv, turn, "user", quoted + own))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    here, first = {}, {}
    for conv, turn, _, t in sorted(rows):
        for h in {quotes._hash(x) for x in quotes.parts(quotes.parse(t)[0])} - {None}:
            here.setdefault((conv, h), turn)
            first.setdefault(h, (conv, turn))
    parent = {}
    for conv, turn, _, t in rows:
        for _, p in sorted(quotes.parse(t)[1], key=lambda x: x[0]):
            for h in (quotes._hash(x) for x in quotes.parts(p)):
                if h is None or (conv, turn) in parent:
                    continue
                if here.get((conv, h), turn) < turn:
                    parent[conv, turn] = (conv, here[conv, h])
                elif h in first and first[h] < (conv, turn):
                    parent[conv, turn] = first[h]
    assert len(parent) > 400
    for conv, turn, _, t in rows:
        at, depth = (conv, turn), 0
        while at in parent:
            at, depth = parent[at], depth + 1
        r = got[conv, turn]
        assert ((r["parent_conv"], r["parent_turn"]), (r["root_conv"], r["root_turn"]), r["depth"], r["n_quotes"]) == (parent.get((conv, turn), (None, None)), at, depth, len(quotes.parse(t)[1]))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0], 0), (1080, [None] * 16, 0), (None, [1.0] * 16, 0)]
    rows += [rows[20], rows[20], rows[33]]  # repeated rows are one
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), block=150).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    e = x.astype(float)
    hits = 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        s = e @ e[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20].tolist()
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 20 == len({i for i, _ in found}) and all(abs(s[i] - v) < 1e-12 * max(1, abs(v)) + 1e-12 for i, v in found)
    assert hits >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[0]] == list(range(100, 120)) and [i for i, _ in got[100]] == [0, *range(101, 120)]


def test_few_neighbours(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(d).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]


@pytest.mark.parametrize("sigma", [0.0, 1.0, 1.5])
def test_neighbours_of_mixed_norms(sigma):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 4096)] + 0.7 * rng.standard_normal((4096, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(0, sigma, (4096, 1))
    forests = [f for part in np.array_split(np.arange(4096), 3) for f in neighbours.bands(part, x[part])]
    met = neighbours.Forest(np.arange(2000), x[:2000]).descend(x[:60], 21)
    assert all(len(i) == 21 for i, _ in met)
    parts = [met, *(f.search(x[:60], np.array([s[-1] for _, s in met]), 21, 0.02) for f in forests)]
    hits = 0
    for q in range(60):
        score = x @ x[q]
        score[q] = -np.inf
        found = sorted({int(i): v for p in parts for i, v in zip(*p[q], strict=True) if i != q}.items(), key=lambda x: -x[1])[:20]
        assert all(abs(score[i] - v) < 1e-9 * max(1, abs(v)) for i, v in found)
        hits += len({i for i, _ in found} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.95 * 20 * 60


def test_bpe(docs, enc):
    for r in bpe.op8_byte_bpe(docs).collect():
        ids = enc.encode_ordinary(TEXT[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TEXT[r["doc_id"]].encode()).hexdigest())


def test_bpe_joins(enc):
    v, rng = bpe.Vocabulary(bpe.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))), random.Random(4)
    for _ in range(2000):
        raw = "".join(rng.choice("abetherin-=") for _ in range(rng.randint(0, 150))).encode()
        assert v.reduce(raw) == v.direct(raw) and v.decode(v.reduce(raw)) == raw


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    size = {i: len(WORD.findall(t)) for i, t in TEXT.items()}
    by, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] in (r["epochs"] * r["size"], (r["epochs"] + 1) * r["size"])
        by[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted((s for s in by if s is not None)) + [None]
    weight = dict(zip(names, [5, 2, 1, 5, 2], strict=True))
    left, free, want = float(sum(by.values())), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * by[s]]
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = 3.0 * by[s]
            left -= want[s]
            free.discard(s)
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.15 * target[s]


def test_mixing_goes_on_past_long_texts(spark):
    rows = [(i, " ".join(["word"] * (4000 if i % 50 == 7 else 5 + i % 17)), "ab"[i % 2]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights, seed in (((5, 3), 42), ((5, 3), 7), ((3, 2), 1)):
        by = defaultdict(list)
        for r in mixing.mix(d, weights=weights, most=2.0, seed=seed).collect():
            by[r["source"]].append(r)
        assert sorted(r["doc_id"] for v in by.values() for r in v) == list(range(400))
        for own in by.values():
            gap = own[0]["target"] - sum(r["taken"] for r in own)
            assert gap >= 0 and not [r for r in own if not r["picked"] and r["epochs"] < 2 and r["size"] <= gap]


def test_mixing_agrees_with_itself(docs):
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(3)))


def test_quality(docs):
    for r in quality.op10_quality_rules(docs).collect():
        t = TEXT[r["doc_id"]]
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), failed)
        assert not (failed and r["kept"])


def test_quality_kept(spark):
    """A host is bad against the others' rates, of all rules; strong soft failures go in any host, mild ones in bad hosts."""
    rng = random.Random(8)
    clean = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40))
    mild, strong, short = (lambda: clean() + " " + "#" * 40), (lambda: clean() + " " + "#" * 120), (lambda: "too short")
    # of 100 documents of each host so many are mild, strong and short; "bad" is so by base failures, under a half of all
    mix = {"bad": (10, 2, 30), "s1": (3, 1, 4), "s2": (5, 0, 4), "s3": (4, 2, 3), "s4": (2, 1, 6), None: (4, 1, 4)}
    rows, want = [], {}
    for host, (a, b, c) in mix.items():
        for k in range(100):
            kind = mild if k < a else strong if k < a + b else short if k < a + b + c else clean
            want[len(rows)] = kind is clean or kind is mild and host != "bad"
            rows.append((len(rows), kind(), host))
    rows.append((len(rows), mild(), "tiny"))  # one document that fails doesn't make a host bad
    want[len(rows) - 1] = True
    got = {r["doc_id"]: r["kept"] for r in quality.op10_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == want


def test_empty_tables(spark, empty):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for f in (jaccard.op1_ngram_jaccard, repeats.op2_suffix_dedup, sharding.op3_vector_packing, maxent.op4_maxent_scoring, edits.op5_edit_counts, bpe.op8_byte_bpe, mixing.op9_mixing, quality.op10_quality_rules):
        assert f(empty).count() == 0
    assert neighbours.op7_hash_prefix_forest(vectors).count() == 0 and quotes.op6_quotation_links(messages).count() == 0


def test_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id long, text string").selectExpr("*", "'s' as source")
    for f in (jaccard.op1_ngram_jaccard, repeats.op2_suffix_dedup, sharding.op3_vector_packing, maxent.op4_maxent_scoring, edits.op5_edit_counts, bpe.op8_byte_bpe, mixing.op9_mixing, quality.op10_quality_rules):
        assert f(d).count() == 4


def test_jaccard_of_awkward_rows(spark, hot=2):
    """Rows without doc_id link like others, different texts of one doc_id are rows of their own; small flushes and blocks."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    near = lambda: " ".join([*base[:50], *(rng.choice("xyz") + str(rng.randint(0, 99)) for _ in range(3)), *base[53:]])
    rows = [(None, near()), (3, near()), (3, "something else " * 9), (None, None), (4, None), (None, "quite alone here"), (7, near()), (7, near()), (None, near()), (8, ""), (9, "quite  alone\there")]
    texts = dict(enumerate(t or "" for _, t in rows))
    sets, parts = sets_and_components(texts)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[parts[k]] = i if least[parts[k]] is None else min(i, least[parts[k]])
    want = sorted(((i, len(sets[k]), least[parts[k]] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, root int").repartition(3)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(d, hot=hot, block=16).collect()), key=str)
    assert got == want
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in jaccard.one_of_each(d, hot=hot).collect())
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[parts[k] if sets[k] else ("bare", k)].append((i is None, i, t or ""))
    assert len(kept) == len(groups)
    for own in groups.values():
        low = min((x[0], -1 if x[1] is None else x[1]) for x in own)
        assert sum((str(i), t) in kept for none, i, t in own if (none, -1 if i is None else i) == low) >= 1


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.array([2**64 - 1], np.uint64), np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64)), np.array([0, 0, 1, 300, 2**63], np.uint64)):
        assert (scratch.unpack64(scratch.pack64(x)) == x).all() and len(scratch.unpack64(scratch.pack64(x))) == len(x)


def test_shared_folder_is_asked_for():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        scratch.folder(Session)
    Context.getConf = staticmethod(lambda: {"spark.checkpoint.dir": "hdfs://x/y/"})
    assert scratch.folder(Session) == "hdfs://x/y"


def test_pipeline(spark, tmp_path):
    """Exact texts before the mixture; after it whole documents, as often as the mix says, and their encodings."""
    import corpus_pipeline
    from tests_llm_brute import brute

    spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        if k == 3:
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            taken = {r["doc_id"]: r["epochs"] + r["picked"] for r in mixing.mix(docs).collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before.items()} == brute(ROWS, sets_and_components) and before
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter({i: n for i, n in taken.items() if n})
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter({(i, hashlib.sha256(before[i].encode()).hexdigest()): n for i, n in taken.items() if n})


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Documents without id or with one that others have go through like others; an empty table gives an empty table."""
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choices("abcdefghijkl", k=5)) for _ in range(60))
    own = [text() for _ in range(8)]
    rows = [(None, own[0]), (None, own[1]), (1, own[2]), (1, own[3]), (2, own[4]), (2, own[4]), (3, own[5]), (4, own[5]), (5, None), (None, ""), (6, "short"), (None, own[6]), (7, own[7])]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
    got = sorted((str(r["doc_id"]), r["text"]) for r in d.collect())
    assert got == sorted([("None", own[0]), ("None", own[1]), ("None", own[6]), ("1", own[2]), ("1", own[3]), ("2", own[4]), ("3", own[5]), ("7", own[7])])
    assert sorted(str(r["doc_id"]) for r in mixing.taken(d).collect()) == sorted(i for i, _ in got)
    spark.createDataFrame([], d.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
