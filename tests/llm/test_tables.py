"""Operators on conversations and embeddings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import chat_format, embedding_dedup, queries

ROW = "conv_id long, turn long, role string, text string, part long, formatted string"


def digests(rows):
    """What the contract says about conversations: (conv_id, turn, role, text) in order."""
    out = {}
    for conv, _, role, text in rows:
        n, turns, chars, loss = out.setdefault(conv, [0, hashlib.sha256(), 0, hashlib.sha256()])
        turns.update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            loss.update((text or "").encode())
            chars += len(text or "")
        out[conv][0], out[conv][2] = n + 1, chars
    return {c: (n, t.hexdigest(), k, s.hexdigest()) for c, (n, t, k, s) in out.items()}


def check(df, **options):
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(chat_format.chat_format(df, **options)).collect()}
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:2]) + (r[2] or "", r[3] or "")
    assert got == digests(sorted(rows, key=key))


def test_conversations(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = {r["conv_id"]: r for r in queries.op3_chat_format(spark, sf_dir).collect()}
    text = r"\### Assistant: </turn> ok"
    assert out[-7]["loss_chars"] == len(text) and out[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert out[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and out[-7]["formatted_chars"] > 2 * len(text)


def test_hostile_texts(spark):
    parts = ["\\", "\\\\", "###", "####", "</turn>", "</turn>\n", "### assistant: ", ": ", "\n", " ", "é", "日本", "\\: ", "#", "<", "", "x" * 3000]
    rng = random.Random(2)
    rows = [(rng.randrange(20), t, "".join(rng.choices(parts, k=2)) if t % 3 == 0 else rng.choice(["user", "assistant"]), "".join(rng.choices(parts, k=rng.randrange(6)))) for t in range(400)]
    rows += [(None, None, None, None), (None, 1, "assistant", None), (5, 3, "assistant", "tie"), (5, 3, "assistant", "tie"), (50, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], ROW)
    check(df)
    check(df, part_chars=500)
    assert chat_format.read_back(chat_format.chat_format(df.limit(0))).count() == 0


def test_long_conversation_is_cut_into_parts(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("ab "), 30).alias("text"))
    parts = chat_format.chat_format(df, part_chars=50_000)
    assert parts.count() > 5 and parts.agg(F.max(F.length("formatted"))).first()[0] <= 50_000
    check(df, part_chars=50_000)


VECTOR = "vec_id long, embedding array<float>, label int, node long, n long"


def brute(rows, cosine=embedding_dedup.COSINE):
    links, parent = {}, {}
    usable = []
    for k, (_, v, label) in enumerate(rows):
        parent[k], links[k] = k, 0
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            usable.append((k, np.array(v, np.float64), label))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, (k, x, a) in enumerate(usable):
        for m, y, b in usable[:i]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[k] += 1
                links[m] += 1
                parent[find(k)] = find(m)
    smallest = {}
    for k, (vec, _, _) in enumerate(rows):
        if vec is not None:
            smallest[find(k)] = min(vec, smallest.get(find(k), vec))
    return sorted(((vec, links[k], smallest.get(find(k)), vec == smallest.get(find(k)) if vec is not None else True) for k, (vec, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("chunk", [2000, 20])
def test_embeddings(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, 2):
        for _ in range(12):
            center = rng.normal(size=32)
            for _ in range(rng.integers(1, 8)):
                v = center + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.12, 0.3])
                rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    one = rows[0][1]
    rows += [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [None] + [1.0] * 31, 1), (9003, [float("nan")] * 32, 1), (9004, [float("inf")] * 32, 1), (9005, one, None), (9006, one[:8], 0), (9007, [], 0), (9008, one, 0), (9009, [2 * x for x in one], 0), (None, one, 0), (9010, [1e-30] * 32, 2)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTOR)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df).collect()), key=str)
    want = brute([(v, e, lab) for v, e, lab in ((r["vec_id"], r["embedding"], r["label"]) for r in df.collect())])
    assert got == want
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_of_the_tables(spark, sf_dir):
    df = queries.op7_embedding_dedup(spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_least_count():
    assert 15 <= embedding_dedup.least_count(0.9999) <= embedding_dedup.least_count(0.9) <= embedding_dedup.LINES


def test_labels_and_lengths_of_any_size(spark):
    rng = np.random.default_rng(1)
    v = [float(x) for x in rng.normal(size=16)]
    big, small = [x * 1e200 for x in v], [x * 1e-200 for x in v]
    rows = [(1, v, 5), (2, v, 5 + 2**32), (3, big, 5), (4, small, 5), (5, [-x for x in v], 5)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {1: (2, 1), 2: (0, 2), 3: (2, 1), 4: (2, 1), 5: (0, 5)}


def test_links_of_many_vectors(spark):
    """Groups of near copies among a thousand others, against brute force by numpy."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(250, 24))
    x = np.concatenate([rng.normal(size=(1000, 24)), *(base + rng.normal(size=base.shape) * 0.1 for _ in range(4))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= embedding_dedup.COSINE
    df = spark.createDataFrame([(i, [float(c) for c in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df).collect()}
    assert near.sum() > 2500 and got == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
