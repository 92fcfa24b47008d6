"""The filter audit, token files and conversation repair."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import conversation_repair, filter_audit, queries, token_files
from packetloom.llm.packing import encoder
from packetloom.llm.sql import ORACLES

from ..oracle import connect, differences

DOCS = "doc_id long, text string, lang string, mask int, class long, part string"


# --- filter audit ------------------------------------------------------------------------------------
def audit_brute(docs, labels):
    says = {}
    for doc_id, quality, toxic in labels:
        good, bad = says.get(doc_id, (0, 0))
        says[doc_id] = (max(good, quality == 1), max(bad, toxic == 1))
    says.pop(None, None)
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    parts = {}
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {f for f, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text), doc_id is not None and doc_id > first[text]), strict=True) if bad}
        parts.setdefault(lang or "", []).append((fails, *says.get(doc_id, (0, 0))))
    out = {}
    for part, rows in parts.items():
        removals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [r for r in rows if f in r[0] and not r[0] & set(order[:k])]
                removals[f] += len(here)
                out[part, order, k + 1] = [sum(not r[0] & set(order[: k + 1]) for r in rows), len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1].append(removals[f])
    return out


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_audit_against_sql(spark, sf_dir):
    assert differences(queries.op11_filter_audit(spark, sf_dir), ORACLES["op11_filter_audit"], connect(sf_dir)) == ""


def test_audit_of_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "B", "É", "日本", "x|", "#", "C d", "e\x1cf", " "]
    long = " ".join(f"w{i % 700}" for i in range(40_000))
    texts = [None, "", " ", "\t\n\x0b\x0c\r", long, long + "!", "X" + long[1:], *(rng.choice([" ", "\n", "\x0b"]).join(rng.choices(words, k=rng.choice([3, 99, 100, 130]))) for _ in range(30)), *(" ".join(f"t{k}" for k in range(n)) for n in (99, 100, 101))]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(None, long, "en"), (None, "", None), (7, "two texts of one id", "en"), (7, "two texts of one id", "en"), (7, "", "de"), (500, "alone", "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 2, "p") for d in docs], DOCS)
    said = spark.createDataFrame([(*x, "t", "l") for x in labels], "doc_id long, quality int, toxic int, text string, lang string")
    want = audit_brute(docs, labels)
    assert audit_rows(filter_audit.filter_audit(df, said)) == want
    monkeypatch.setattr(filter_audit, "LEAST_SHARE", 3)  # frequent classes in several shares
    monkeypatch.setattr(filter_audit, "SHARES", 10_000)
    assert audit_rows(filter_audit.filter_audit(df, said)) == want
    assert filter_audit.filter_audit(df.limit(0), said).count() == 0


def test_texts_whose_hashes_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "class_of", lambda rounds: F.lit(5).cast("long"))
    docs = [(i, f"text {i % 4}", "en") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    classes = spark.createDataFrame([(5, 40)], "class long, size long")
    assert sorted(r["doc_id"] for r in filter_audit.later_copies(df, classes, 40).collect()) == list(range(4, 40))


def test_refinement_drops_what_stands_alone(spark):
    docs = [(1, "abc", "en"), (2, "abd", "en"), (3, "abcd", "en"), (4, "x" * 5000 + "y", "en"), (5, "x" * 5001, "en"), (6, "abc", "en")]
    signed = filter_audit.with_blocks(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert [r["size"] for r in filter_audit.repeated_classes(signed, 6).collect()] == [2]


# --- token files --------------------------------------------------------------------------------------
def encoded(docs, ordered):
    """By the tokenizers library: ids of all documents in the given order, with their starts."""
    reference, out, start = encoder(queries.tokenizer_path()).reference, [], 0
    for doc_id, text in ordered(docs):
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_tables(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op12_token_files(spark, sf_dir).collect())
    assert got == encoded(docs, sorted)


@pytest.fixture(scope="module")
def odd_files(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = [None, "", "!", "!!", "<|endoftext|>", "é日本 ", "a b\n\nc", "word " * 20_000]
    docs = [(i * 3 - 300, rng.choice([*texts, f"text {i}"])) for i in range(400)] + [(None, "none"), (None, None), (9, "again"), (9, "again"), (9, "other")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n long, shard long")
    folder = str(tmp_path_factory.mktemp("ids") / "files")
    return docs, folder, token_files.write_ids(df, folder, queries.tokenizer_path(), shard_ids=3000)


def test_odd_documents_come_back_by_key(spark, odd_files):
    docs, folder, made = odd_files
    assert made["n_docs"] == len(docs) and len(made["shards"]) > 10 and made["width"] == 2
    rows = token_files.read_ids(token_files.lookup(token_files.keys(spark, folder), folder), folder).collect()
    reference = encoder(queries.tokenizer_path()).reference
    want = sorted((d is not None, d or 0, [*reference.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in docs)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in rows) == want
    places = sorted((r["start"], r["n_tokens"], r["doc_id"] is not None, r["doc_id"] or 0, r["nth"]) for r in rows)
    assert places[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:])) and places[-1][0] + places[-1][1] == made["n_ids"]
    assert [p[2:] for p in places] == sorted(p[2:] for p in places)
    reader = token_files.Reader(folder)
    for r in rows[:60]:
        assert reader.get(r["doc_id"], r["nth"]).tolist() == r["ids"]
    assert reader.get(10**12) is None and reader.get(9, 7) is None
    unknown = spark.range(10**9, 10**9 + 5000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("nth"))
    assert token_files.lookup(unknown, folder).count() == 0


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path / "none")
    made = token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), folder, queries.tokenizer_path())
    assert made["n_docs"] == made["n_ids"] == 0 and token_files.keys(spark, folder).count() == 0
    assert token_files.lookup(spark.createDataFrame([(1, 0)], "doc_id long, nth long"), folder).count() == 0 and token_files.Reader(folder).get(1) is None


@pytest.mark.parametrize("n", [1, 2, 63, 5000, 40_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
    a[: n // 3] = a[0]  # one hash may be equal, not both
    sizes, bits = token_files._levels(a, b)
    assert int(token_files._ONES[bits].sum()) == n and sum(sizes) < max(640, 6 * n)
    data = token_files.build_bucket(a, b, np.arange(n), np.arange(n) * 7, np.arange(n) + 1)
    there, slots = token_files.find_in_bucket(data, a, b)
    assert there.all() and slots["shard"].tolist() == list(range(n)) and slots["n"].tolist() == list(range(1, n + 1))
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert token_files.find_in_bucket(data, other, other)[0].sum() <= 1


# --- conversation repair -------------------------------------------------------------------------------
def least_edits(rows: str):
    """Cheapest edits of rows as the parser sees them, by trying all."""
    found = []
    after = {"empty": "asked", "opened": "asked", "reply": "asked", "asked": "reply"}

    def go(i, state, cost, audit, inserted):
        if found and cost > found[0][0]:
            return
        if i == len(rows) and state in ("empty", "reply"):
            found[:] = [min([*found, (cost, audit)])]
        if inserted < 2:
            go(i, after[state], cost + 5, audit + "I", inserted + 1)
        if i < len(rows):
            go(i + 1, state, cost + 2, audit + "D", 0)
            row, cut = rows[i].lower(), 5 * rows[i].isupper()
            if row == "d":
                return
            if (row, state) == ("s", "empty"):
                go(i + 1, "opened", cost + cut, audit + "K", 0)
            if (row == "u" and state != "asked") or (row == "a" and state == "asked"):
                go(i + 1, after[state], cost + cut, audit + "K", 0)
            go(i + 1, after[state], cost + cut + 1, audit + "R", 0)

    go(0, "empty", 0, "", 0)
    return found[0]


def test_parser_finds_the_cheapest_edits():
    rng = random.Random(5)
    for n in range(7):
        for _ in range(60):
            rows = "".join(rng.choices("dsuaxSUAX", weights=[2, 3, 5, 5, 1, 1, 1, 1, 1], k=n))
            assert conversation_repair.best(conversation_repair.parse(rows))[0] == least_edits(rows)


def repair_brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort()
        turns = {t for known, t, _, _ in held if known}
        seen, read, faults = set(), "", [0, 0, 0]
        for _, _, role, text in held:
            plain = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not plain else 1 if (role, text) in seen else 2 if plain[-1] not in ".!?" else None
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            read += "d" if fault in (0, 1) else letter.upper() if fault == 2 else letter
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
        (cost, audit), _ = conversation_repair.best(conversation_repair.parse(read))
        lines, left, first = [], iter(held), None
        for edit in audit:
            _, _, role, text = next(left) if edit != "I" else (0, 0, "", "")
            if edit != "D":
                first = (edit == "K" and role[:1] == "s") if first is None else first
                role = role if edit == "K" else "user" if (len(lines) - first) % 2 == 0 else "assistant"
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(held, held[1:])]
        gap = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gap, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repair_rows(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_repair_of_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repair_rows(queries.op13_conversation_repair(spark, sf_dir)) == repair_brute(rows)


@pytest.mark.parametrize("segment", [256, 5])
def test_repair_of_odd_rows(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", segment)
    rng = random.Random(6)
    texts = [None, "", " \t", "a.", "b!", "c? ", "d", "é日本。", "e.\n", "x" * 5000 + "."]
    rows = [(rng.randrange(12), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "assistant", "system", "", None, "Up", "ursula", "tool"]), rng.choice(texts)) for _ in range(150)]
    rows += [(50, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", "same.", f"{t // 5}", ""])) for t in range(700)]  # a long one
    rows += [(None, 1, "user", "q?"), (None, 2, "assistant", "a."), (None, None, None, None), (51, None, "user", "x."), (52, 3, "user", "tie."), (52, 3, "user", "tie."), (52, 3, "user", "tie.")]
    rows += [(c, 0, "user", "dropped or not?") for c in range(100, 160)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "clash", 9) for r in rows], "conv_id long, turn long, role string, text string, segment long, audit string, cost int")
    found = repair_rows(conversation_repair.digests(*conversation_repair.repair(conversation_repair.damaged(df))))
    assert found == repair_brute(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found.values()  # nothing was left
    assert conversation_repair.digests(*conversation_repair.repair(conversation_repair.damaged(df.limit(0)))).count() == 0


def test_segments_make_what_one_parse_makes():
    rng = random.Random(7)
    for _ in range(40):
        rows = "".join(rng.choices("dsuaxSUAX", weights=[2, 3, 5, 5, 1, 1, 1, 1, 1], k=24))
        ways = {conversation_repair.EMPTY: (0, "")}
        for begin in range(0, 24, 5):
            new = {}
            for entry, (cost, audit) in ways.items():
                for state, (c, more) in conversation_repair.parse(rows[begin : begin + 5], entry).items():
                    new[state] = min(new.get(state, (10**9, "")), (cost + c, audit + more))
            ways = new
        assert conversation_repair.best(ways) == conversation_repair.best(conversation_repair.parse(rows))
