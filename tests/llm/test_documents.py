"""Operators on documents: brute force on the smallest tables, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import chat_format, fingerprints, gbt, lang_id, line_dedup, mixing, ngram_join, packing, quality, queries, toxicity
from packetloom.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, label string, sequence_id long, word string"


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names the operators use themselves."""
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [(0, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, "One TWO"), (5, long), (6, long + " end"), (7, "a b c d e f g h i j k l\nline two\nline two"), (7, "a b c d e f g h i j k l\nline two\nline two"), (None, "a null id"), (9, "x" * 5000), (10, "<|endoftext|> é 日本語 \u0085")]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, 0.5, 1, "l", 2, "w") for k, (i, t) in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# --- components --------------------------------------------------------------------------------------
def test_components(spark):
    random.seed(1)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)]
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}
    assert components(df.limit(0)).count() == 0


# --- packing -----------------------------------------------------------------------------------------
def test_token_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    ours, theirs = packing.Encoder(path), Tokenizer.from_file(path)
    assert ours.fast is not None
    for text in ("", "Hello  world\n\n don't  x", "Ünï çödé éà", "a<|endoftext|>b", "日本 \u0085  z", "\x1c tab\t 123 4567", "   ", "###%%% a" * 50):
        assert ours(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity=packing.CAPACITY):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs):
    rows = packing.best_fit_packing(docs, queries.tokenizer_path()).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(rows) <= -(-total // packing.CAPACITY) * 1.02 + 1
    encode = packing.Encoder(queries.tokenizer_path())
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    for d in docs.limit(40).collect():
        ids = np.append(encode(d["text"]), 0).astype("<u4")
        own = [pieces[d["doc_id"], k] for k in range(sum(1 for x in pieces if x[0] == d["doc_id"]))]
        assert sum(p["length"] for p in own) == len(ids) and (len(ids) > packing.CAPACITY or len(own) == 1)
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
            assert p["piece"] == 0 or p["length"] == packing.CAPACITY


def test_packing_merges_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 100)
    items = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"), F.lit(None).cast("long").alias("start"))
    rows = packing.pack(items, ["doc_id", "start", "length"], 1000).collect()
    assert len(rows) == 3000 and {r["start"] for r in rows} == {None}
    at_once = packing.best_fit(np.array([r["length"] for r in rows]), 1000).max() + 1
    assert check_packing(rows, 1000) <= at_once * 1.08 + 1  # groups of 100 items; real ones are of 50,000


def test_the_carry_bound_loses_nothing(spark, monkeypatch):
    """Fewer bins handed up close some early; on mixes of lengths it costs at most one sequence in 200."""
    monkeypatch.setattr(packing, "GROUP_ITEMS", 1000)
    rng = random.Random(2)
    for draw in (lambda: rng.randrange(1, 2049), lambda: int(2048 * rng.random() ** 3) + 1, lambda: rng.choice([1100, 900, 700, 3])):
        lengths = [draw() for _ in range(8000)]
        df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
        n = {}
        for carry in (5, 4096):
            monkeypatch.setattr(packing, "CARRY", carry)
            rows = packing.pack(df, ["doc_id", "length"]).collect()
            assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
            check_packing(rows)
            n[carry] = len({r["sequence_id"] for r in rows})
        assert n[4096] <= n[5] <= n[4096] * 1.005 + 1


def test_rows_of_no_id_are_dealt_to_all_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 100)
    seen = []
    real = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    docs = spark.createDataFrame([(None, "the same text")] * 1000, "doc_id long, text string")
    assert packing.best_fit_packing(docs, queries.tokenizer_path()).count() == 1000
    first = dict(seen)["pack-0"]
    assert first.select("grp").distinct().count() == 10


def test_packing_odd(odd, empty):
    path = queries.tokenizer_path()
    rows = packing.best_fit_packing(odd, path).collect()
    assert check_packing(rows) and sum(r["doc_id"] == 7 for r in rows) == 2 and {r["length"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert packing.best_fit_packing(empty, path).count() == 0
    once = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.best_fit_packing(once, path)
    for r in packing.sequences(once, packed, path).collect():
        assert r["length"] == len(r["ids"]) <= packing.CAPACITY


# --- n-gram join -------------------------------------------------------------------------------------
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_join(pairs):
    sets = []
    for _, text in pairs:
        w = WORD.findall((text or "").encode().lower())
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i in range(len(pairs))}
    index, seen = defaultdict(list), {}
    for i, s in enumerate(sets):
        if not s:
            continue
        counts = defaultdict(int)
        for g in s:
            for j in index[g]:
                counts[j] += 1
            index[g].append(i)
        for j, n in counts.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    smallest = {}
    for i, (doc, _) in enumerate(pairs):
        root = find(parent, i)
        if doc is not None:
            smallest[root] = min(smallest.get(root, doc), doc)
    return [(doc, len(sets[i]), smallest.get(find(parent, i))) for i, (doc, _) in enumerate(pairs)], seen


def check_join(df):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()), key=str)
    want, _ = brute_join([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert got == sorted(want, key=str)


def test_ngram_join(docs, odd, empty):
    check_join(docs)
    check_join(odd)
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_of_large_groups(spark, monkeypatch):
    """Families of variants around the threshold, of frequent tokens and in several blocks."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(3)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60 + 40 * family)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3))):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


# --- language ----------------------------------------------------------------------------------------
def test_language(spark, sf_dir, docs, odd, empty):
    got = queries.op4_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    model = lang_id.fit(docs)
    rows = {r["doc_id"]: r for r in lang_id.predict(odd, model).collect()}
    assert len(lang_id.predict(odd, model).collect()) == 12
    assert all((rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0) for i in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[5]["lang_pred"] in model.langs
    assert lang_id.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in lang_id.predict(odd, lang_id.fit(empty)).collect()} == {"und"}


def test_characters_that_are_no_letters(spark, docs):
    model = lang_id.fit(docs)
    rows = spark.createDataFrame([(0, "½ ² Ⅷ ① 12"), (1, "½ x"), (2, "日本"), (3, "\u0301")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in lang_id.predict(rows, model).collect()} == {0: True, 1: False, 2: False, 3: True}
    assert lang_id.words_of("a½b Ⅷc d²") == ["a", "b", "c", "d"] and lang_id.words_of(None) == []


def test_a_small_language_keeps_its_words(spark):
    rows = [("en", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(500)))] * 20 + [("xx", "zuq vey zuq bip")]
    model = lang_id.fit(spark.createDataFrame(rows, "lang string, text string"), n_words=40, n_grams=200)
    assert {"zuq", "vey", "bip"} <= set(model.words) and len(model.words) <= 40 and len(model.grams) <= 200
    assert lang_id.predict(spark.createDataFrame([(1, "zuq bip")], "doc_id long, text string"), model).first()["lang_pred"] == "xx"


def brute_language(text, train):
    """Scores by counting everything again, word by word."""
    counts, grams, size = defaultdict(Counter), defaultdict(Counter), Counter()
    langs = sorted({lang for lang, _ in train})
    for lang, t in train:
        for w in re.findall(r"[a-zäöüßñáéíóú]+", t.lower()):
            counts[lang][w] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    grams[lang][f"^{w}$"[i : i + n]] += 1
                    size[lang, n] += 1
    vocabulary, pieces = set().union(*counts.values()), set().union(*grams.values())
    total = dict.fromkeys(langs, 0.0)
    for w in re.findall(r"[a-zäöüßñáéíóú]+", text.lower()):
        if w in vocabulary:
            for lang in langs:
                total[lang] += np.log((counts[lang][w] + 0.5) / (counts[lang].total() + 0.5 * len(vocabulary)))
            continue
        marked, found = f"^{w}$", []
        for i in range(len(marked)):
            found += [g for n in range(4, 0, -1) if (g := marked[i : i + n]) in pieces][:1]
        for lang in langs:
            total[lang] += sum(np.log((grams[lang][g] + 0.5) / (max(size[lang, len(g)], 1) + 0.5 * len(pieces))) for g in found) / max(len(found), 1)
    best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(np.exp(total[x] - total[best]) for x in langs)


def test_language_against_brute_force(spark):
    train = [("de", "der hund und die katze schlafen"), ("en", "the dog and the cat are sleeping"), ("es", "el perro y el gato duermen")]
    texts = ["the cat", "die katze und der vogel", "el gato grande", "sleeper hunde", "xyz", "the perro und cat"]
    model = lang_id.fit(spark.createDataFrame(train, "lang string, text string"))
    rows = lang_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        lang, score = brute_language(texts[r["doc_id"]], train)
        assert (r["lang_pred"], round(r["score"], 4)) == (lang, round(score, 4))


def test_unseen_words_back_off(docs):
    model = lang_id.fit(docs)
    scores = lang_id._Scores(model)
    at = scores["zzqqxyunseen"]
    marked, total, n = "^zzqqxyunseen$", np.zeros(len(model.langs)), 0
    for i in range(len(marked)):
        for size in range(4, 0, -1):
            if marked[i : i + size] in model.grams:
                total, n = total + model.gram_logp[model.grams[marked[i : i + size]]], n + 1
                break
    assert np.allclose(scores.settled()[at], total / n, atol=1e-4)


# --- quality and toxicity ----------------------------------------------------------------------------
def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = gbt.fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert np.allclose(gbt.fit(x[:0], y[:0]).score(x[:3]), 0.5)
    assert (gbt.fit(x[:50], np.ones(50)).score(x[:3]) > 0.9).all()


def test_statistics():
    assert quality.statistics("") == quality.statistics(" \n") == [0.0] * len(quality.STATISTICS)
    assert len(quality.statistics("a b\nc")) == len(quality.STATISTICS) and np.isfinite(quality.statistics("é | ### " * 99)).all()


@pytest.mark.parametrize("name", ["op5_quality_classifier", "op6_toxicity"])
def test_held_out_accuracy(spark, name):
    sf_dir, column = "/root/testdata/sf0.01", "quality" if name == "op5_quality_classifier" else "toxic"
    rows = queries.QUERIES[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[column] for r in held) >= 0.9 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_odd_scores(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (77, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for score in (quality.quality, toxicity.toxicity):
        rows = score(odd, labels).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
        assert score(empty, labels).count() == 0
        assert score(odd, labels.limit(0)).count() == 12


def test_grammar():
    grammar = toxicity.Grammar(toxicity.seeds(), {"blor": 2.0})
    scanner = toxicity.Scanner(grammar)
    weigh = scanner.weight
    assert weigh("") == 0 and weigh("a fine day. you are kind") == 0
    plain = weigh("an idiot stood there")
    assert weigh("you are an idiot") > plain > weigh("he said that an idiot stood there".replace("he ", "")) > 0
    assert weigh("this is not an idiot") < plain
    assert weigh("I will kill you") > weigh("kill the process") > 0
    assert weigh("blorum is here") > 0 and weigh("xblorum is here") == 0
    clauses = list(scanner.clauses("Fine so far. You moron! Fine again."))
    assert len(clauses) == 1 and "moron" in "Fine so far. You moron! Fine again."[clauses[0][0] : clauses[0][1]]
    assert weigh("İ idiot " * 3) > 0


def test_long_junk_is_read_once():
    import time

    scanner = toxicity.Scanner(toxicity.Grammar(toxicity.seeds(), {"kill": 0.0}))
    began = time.perf_counter()
    assert scanner.weight("killer " * 20_000) == 0.0
    assert time.perf_counter() - began < 1


def test_grammar_is_composed_of_five_machines():
    """The table against the machines run one after the other."""
    machines = (toxicity.insult(), toxicity.threat(), toxicity.target(), toxicity.negation(), toxicity.reported())
    rng = random.Random(1)
    words = ("other", "insult", "threat", "target", "negation", "report")
    for _ in range(500):
        clause = [(rng.choice(words), 1.0) for _ in range(rng.randrange(1, 12))]
        states = [m.start for m in machines]
        sums = {"insult": 0.0, "threat": 0.0}
        for symbol, weight in clause:
            out = symbol
            for k, m in enumerate(machines):
                states[k], out = m.step(states[k], out)
            if out in toxicity.SHARE:
                sums[out.split("-")[0]] += weight * toxicity.SHARE[out]
        aimed = any(s == "target" for s, _ in clause)
        want = sums["insult"] * (toxicity.TARGETED if aimed else 1) + sums["threat"] * (1 if aimed else toxicity.UNTARGETED_THREAT)
        assert toxicity.clause_weight(clause) == pytest.approx(want)
        assert (want > 0) == any(s in ("insult", "threat") for s, _ in clause)


# --- fingerprints ------------------------------------------------------------------------------------
def plain_anchors(text):
    """Anchors by the definition, a k-mer at a time."""
    hashed = lambda x: int(fingerprints._hashes(np.array([ord(c) for c in x], np.uint32), None, len(x))[0])
    inner = [hashed(text[i : i + 9]) for i in range(len(text) - 8)]
    out = [(i, hashed(text[i : i + 24])) for i in range(len(text) - 23) if min(inner[i : i + 16]) in (inner[i], inner[i + 15])]
    if not out and len(text) >= 24:
        out = [min(((i, hashed(text[i : i + 24])) for i in range(len(text) - 23)), key=lambda x: x[1])]
    return out


def anchor_list(found):
    return list(zip(*(x.tolist() for x in found), strict=True))


def test_anchors_are_closed_syncmers(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("日本語 abcdeé😀") for _ in range(n)) for n in (1, 23, 24, 25, 26, 27, 30, 38, 39, 60, 500)] + ["", "a" * 40, "", "b" * 23]
    for piece in (fingerprints.PIECE, 7, 100):
        monkeypatch.setattr(fingerprints, "PIECE", piece)
        for text, found in zip(texts, fingerprints.anchors(texts), strict=True):
            if len(text) >= 24:
                assert anchor_list(found) == plain_anchors(text)
            else:
                assert [p for p, _ in anchor_list(found)] == [0] * (text != "")
    assert fingerprints.anchors([]) == []


def test_anchors_do_not_depend_on_context():
    passage = " ".join(f"p{i * i % 97}" for i in range(60))
    a, b = fingerprints.anchors([f"some words before {passage} and after", f"quite another beginning of it all {passage}"])
    shifts = [y - x for x, y in zip(*fingerprints.matches(a, b), strict=True)]
    assert len(shifts) >= 8 and shifts.count(16) >= 8


def test_an_edit_of_a_text_without_spaces_leaves_anchors():
    rng = random.Random(9)
    text = "".join(rng.choice("日月火水木金土山川田人口") for _ in range(300))
    a, b = fingerprints.anchors([text, text[:150] + "x" + text[151:]])
    assert len(fingerprints.matches(a, b)[0]) >= 0.7 * len(a[0])


def test_edited_fingerprints(docs, odd, empty):
    for df in (docs, odd):
        rows = fingerprints.edited_fingerprints(df).collect()
        plain = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        assert len(rows) == len(plain)
        distinct = sorted(set(plain), key=lambda x: (x[0] is not None, x[0] or 0))
        want = {}
        for (i, text), (_, after) in zip(distinct, distinct[1:] + distinct[:1], strict=True):
            n = len(text)
            want[i] = (n, hashlib.sha256((text[: n - n // 2] + after[: n // 2]).encode()).hexdigest())
        assert all((r["n_chars"], r["edited_sha256"]) == want[r["doc_id"]] for r in rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
        same = defaultdict(set)
        texts = dict(plain)
        for r in rows:
            same[texts[r["doc_id"]]].add(r["fingerprint"])
        assert all(len(x) == 1 for x in same.values())
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert fingerprints.fingerprint(odd).count() == 12


def test_fingerprints_hold_every_anchor(docs, odd):
    def digits(found):
        return "".join(f"{p:08x}{h:016x}" for p, h in anchor_list(found))

    def like(a, b):
        a, b = (Counter(h for _, h in anchor_list(y)) for y in (a, b))
        return (a & b).total() / (a | b).total() if a or b else 1.0

    for df in (docs, odd):
        plain = sorted({(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()}, key=lambda x: (x[0] is not None, x[0] or 0))
        want = {}
        for (i, text), (_, after) in zip(plain, plain[1:] + plain[:1], strict=True):
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            own, new, following = (fingerprints.anchors([x])[0] for x in (text, edited, after))
            assert len(text) > 3000 or len(text) < 24 or anchor_list(own) == plain_anchors(text)
            want[i] = digits(own), digits(new), like(own, new), like(own, following)
        for r in fingerprints.edited_fingerprints(df).collect():
            assert (r["fingerprint"], r["edited_fingerprint"]) == want[r["doc_id"]][:2]
            assert (r["near_edited"], r["near_next"]) == pytest.approx(want[r["doc_id"]][2:], abs=1e-9)
        for r in fingerprints.fingerprint(df).collect():
            assert r["fingerprint"] == want[r["doc_id"]][0] == "".join(f"{x['position']:08x}{x['hash'] % 2**64:016x}" for x in r["anchors"])


def test_fingerprints_run_no_python(docs):
    """The operator is made of DataFrame functions; its plan has no node that starts Python."""
    plan = fingerprints.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_repeated_passages_are_matched_by_number(spark):
    """Hashes that come often in both texts, in one of them, or in none."""
    line = "a passage of some length that is repeated, again and again; "
    rows = [(0, line * 9), (1, line * 4 + "and then it goes on with something else, which was not there before"), (2, "x" * 90), (3, "x" * 40), (4, ""), (5, line * 2)]

    def like(a, b):
        a, b = (Counter(h for _, h in anchor_list(fingerprints.anchors([x])[0])) for x in (a, b))
        return (a & b).total() / (a | b).total() if a or b else 1.0

    texts = dict(rows)
    for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text, after = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % 6]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(text, edited), like(text, after)), abs=1e-9)


# --- lines -------------------------------------------------------------------------------------------
def line_shingles(line):
    return frozenset(line[i : i + line_dedup.SHINGLE] for i in range(len(line) - line_dedup.SHINGLE + 1))


def brute_lines(pairs):
    places = defaultdict(list)
    for doc, text in pairs:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                places[line].append((doc, i))
    every = list(places)
    sets = [line_shingles(x) for x in every]
    parent = {i: i for i in range(len(every))}
    index = defaultdict(list)
    for i, s in enumerate(sets):
        counts = defaultdict(int)
        for g in s:
            for j in index[g]:
                counts[j] += 1
            index[g].append(i)
        for j, n in counts.items():
            if 100 * n >= line_dedup.SIMILARITY * (len(s) + len(sets[j]) - n):
                parent[find(parent, i)] = find(parent, j)
    groups = defaultdict(list)
    for i, line in enumerate(every):
        groups[find(parent, i)] += places[line]
    keep = {min(g) for g in groups.values()}
    return {doc: "\n".join(line for i, line in enumerate(text.split("\n")) if not line.strip() or (doc, i) in keep) for doc, text in pairs}


def test_line_dedup(docs):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    wrong = sum(got[d] != want[d] for d in want)
    assert wrong <= 0.01 * len(want)


def test_large_line_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(7)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(40)] = f"new{rng.randrange(10**6)}"
        rows.append((i, f"own line {i} {rng.random()}\n{' '.join(words)}"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert sum(got[d] != want[d] for d in want) <= 3


@pytest.mark.parametrize("rounds", [0, 2])
def test_links_between_lines_that_no_leader_is_linked_with(spark, monkeypatch, rounds):
    """A family in which each line is near two others only: a chain."""
    monkeypatch.setattr(ngram_join, "CLOSEST_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    rows = []
    for i in range(60):
        words[(7 * i) % 40] = "".join(rng.choice("klmnopqrst") for _ in range(6))
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) and got[59] == ""


def test_min_hashes_of_lines_of_any_length(monkeypatch):
    rng = random.Random(5)
    found = ["".join(rng.choice("abc é日") for _ in range(n)) for n in (5, 300, 6, 2000, 41)]
    whole = line_dedup.minima(*line_dedup.characters(found))
    monkeypatch.setattr(line_dedup, "PIECE", 37)
    assert (line_dedup.minima(*line_dedup.characters(found)) == whole).all()
    a, b = (line_shingles(x) for x in (found[3], found[3][:1700]))
    values = line_dedup.minima(*line_dedup.characters([found[3], found[3][:1700]]))
    assert abs((values[:, 0] == values[:, 1]).mean() - len(a & b) / len(a | b)) < 0.3


def test_a_line_everywhere_and_a_text_of_many_lines(spark):
    rows = [(i, f"the same line in all of them\nown line {i} {i * 7919}") for i in range(300)] + [(1000, "\n".join(f"line number {i * i} of many {i}" for i in range(30_000)))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] >= 1 and got[i]["n_lines"] == 2 for i in range(1, 300))
    assert got[1000]["n_lines"] == 30_000 and got[1000]["n_removed"] + got[1000]["text"].count("\n") + 1 == 30_000


def test_odd_lines(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == 12 and set(odd.columns) <= set(rows[0].asDict())
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[0][0]["text"] is None and by[1][0]["text"] == "" and by[2][0]["text"] == "   \n\t "
    assert [r["text"] for r in by[7]] == ["a b c d e f g h i j k l\nline two"] * 2 and by[7][0]["n_removed"] == 1
    assert by[6][0]["text"] == "" and by[None][0]["text"] == "a null id"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_one_changed_character(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        letters = "abcdefghijklmnopqrstuvwxyz" if k % 3 else "日月火水木金土山川田人口車門雨風花鳥空海"
        line = "".join(" " if k % 3 == 1 and i % 6 == 5 else rng.choice(letters) for i in range(60))  # also without spaces
        at = rng.randrange(8, 50)
        a, b = line, line[:at] + "#" + line[at + 1 :]
        assert len(line_shingles(a) & line_shingles(b)) >= 0.8 * len(line_shingles(a) | line_shingles(b))
        rows += [(2 * k, a), (2 * k + 1, b)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] for k in range(120)) >= 119


# --- mixing ------------------------------------------------------------------------------------------
def test_shortages_go_to_siblings_first():
    leaves = [(("a", "x"), 10.0), (("a", "y"), 1000.0), (("b", "x"), 1000.0)]
    root = mixing.tree(leaves, {})
    mixing.assign(root, 200.0, 1)
    target = {leaf.path: leaf.target for leaf in mixing.leaves_of(root)}
    assert target == pytest.approx({("a", "x"): 10.0, ("a", "y"): 90.0, ("b", "x"): 100.0})
    root = mixing.tree([(("a", "x"), 10.0), (("a", "y"), 20.0), (("b", "x"), 1000.0)], {("b",): 3.0})
    mixing.assign(root, 200.0, 1)
    assert {leaf.path: leaf.target for leaf in mixing.leaves_of(root)} == pytest.approx({("a", "x"): 10.0, ("a", "y"): 20.0, ("b", "x"): 170.0})
    root = mixing.tree([(("a",), 10.0), (("b",), 10.0)], {("a",): 0.0})
    mixing.assign(root, 100.0, 2)
    assert [leaf.target for leaf in mixing.leaves_of(root)] == [0.0, 20.0]


def test_mixing(docs):
    levels = queries.mix_levels()
    out = mixing.mix(docs, levels, queries.MIX_WEIGHTS, 0.8, mixing.word_tokens(), max_epochs=3, seed=42).collect()
    rows = docs.select("doc_id", *[v.alias(f"_{k}") for k, v in levels.items()], mixing.word_tokens().alias("n"), F.xxhash64("doc_id", "text").alias("h")).collect()
    leaf = lambda r: tuple(r[f"_{k}"] for k in levels)
    supply = defaultdict(int)
    for r in rows:
        supply[leaf(r)] += r["n"]
    root = mixing.tree([(k, float(v)) for k, v in supply.items()], queries.MIX_WEIGHTS)
    mixing.assign(root, 0.8 * sum(supply.values()), 3)
    want = set()
    for node in mixing.leaves_of(root):
        whole, rest = divmod(int(node.target + 1e-6), int(node.supply))
        own = [r for r in rows if leaf(r) == node.path]
        want |= {(r["doc_id"], e) for r in own for e in range(whole)}
        places = {x["doc_id"]: x["p"] for x in docs.select("doc_id", F.xxhash64(F.lit(42), F.lit(whole).cast("long"), F.xxhash64("doc_id", "text")).alias("p")).where(F.col("doc_id").isin([r["doc_id"] for r in own])).collect()}
        taken = 0
        for r in sorted(own, key=lambda r: places[r["doc_id"]]):
            taken += r["n"]
            if not rest or taken > rest:
                break
            want.add((r["doc_id"], whole))
    assert {(r["doc_id"], r["epoch"]) for r in out} == want and len(out) == len(want)


def test_mixing_odd(odd, empty):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(odd, levels, {}, 1.0, mixing.word_tokens(), max_epochs=2)
    assert out.count() >= 8 and set(odd.columns) <= set(out.columns)
    assert mixing.mix(empty, levels, {}, 1.0, mixing.word_tokens()).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------
def test_pipeline(spark, sf_dir, docs):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    clean = corpus_pipeline.reject_toxic(spark, docs, sf_dir)
    rejected = docs.join(clean, "doc_id", "left_anti").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("toxic = 0").count()
    assert rejected <= 2 and clean.columns == list(corpus_pipeline.COLUMNS)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd, empty):
    for df in (odd, empty):
        rows = df.select(*corpus_pipeline.COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            out.count()
    kept = corpus_pipeline.dedup_documents(spark, odd, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 1, 2, 3, 5, 7, 9, 10]


def test_pipeline_keeps_other_texts_of_an_id(spark, sf_dir):
    copy = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(1, copy), (2, copy + " end"), (2, other), (None, copy + " more"), (None, "alone " + other[::-1]), (None, None), (4, copy)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_documents(spark, docs, sf_dir).collect()}
    assert got == {(1, copy), (2, other), (None, "alone " + other[::-1]), (None, None)}


def test_languages_share_the_model(spark):
    """Words that occur once each, in a language that has nothing else: ties are broken, and unused shares go to the others."""
    rows = [("a", f"a{i}", 1) for i in range(200)] + [("b", f"b{i}", 1 + i) for i in range(10)] + [("c", f"c{i}", 1 + i % 5) for i in range(500)]
    counts = spark.createDataFrame(rows, "lang string, word string, n long")
    known, n = lang_id._most_frequent(counts, "word", 300, ["a", "b", "c"])
    of = {x: [w for w in known if w[0] == x] for x in "abc"}
    assert {x: len(w) for x, w in of.items()} == {"a": 145, "b": 10, "c": 145} and n.shape == (300, 3)
    assert sorted((n[known[w]].max() for w in of["c"]), reverse=True) == [5.0] * 100 + [4.0] * 45
    many = spark.createDataFrame([(f"l{k}", f"w{k}-{i}", 1) for k in range(500) for i in range(20)], "lang string, word string, n long")
    known, _ = lang_id._most_frequent(many, "word", 5000, [f"l{k}" for k in range(500)])
    assert len(known) == 5000 and {sum(w.startswith(f"w{k}-") for w in known) for k in (0, 7, 499)} == {10}


@pytest.mark.parametrize(("sizes", "limit", "level"), [([200, 10, 500], 300, 145), ([5, 5], 100, 5), ([5, 500], 100, 95), ([1, 1, 1], 2, 1), ([], 9, 1)])
def test_shares_of_languages(sizes, limit, level):
    assert lang_id._level(sizes, limit) == level


def test_toxic_documents_are_found(spark):
    """Recall and false alarms apart, on documents whose labels weren't learned."""
    d = "/root/testdata/sf0.1"
    scored = queries.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null"), "doc_id")
    found = {(r["toxic"], r["predicted"]): r["n"] for r in scored.where("held_out").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    toxic, clean = found.get((1, 1), 0) + found.get((1, 0), 0), found.get((0, 0), 0) + found.get((0, 1), 0)
    assert toxic > 30 and found.get((1, 1), 0) >= 0.9 * toxic and found.get((0, 1), 0) <= 0.01 * clean, found
