import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from readwindows.functions import kmers
from readwindows.functions import similarity as similarity_functions
from readwindows.functions.similarity import BITS_PER_LETTER, BITS_PER_LETTER_OF_FOUR, Signed, four_signatures, lcs_lengths, like_pairs, run_signatures
from readwindows.operators import features, similarity

SEQUENCES = ["", "ACG", "ACGTAC", "ACGTACGTTT", "acgtacgt", "ACGNACGTACG", "TTTTTTT", "AÇGTÄCGT"]


def table(spark):
    return spark.createDataFrame(list(enumerate(SEQUENCES)), "id bigint, s string")


def column(spark, expression):
    return [r.v for r in table(spark).select("id", expression.alias("v")).orderBy("id").collect()]


def pieces(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


@pytest.mark.parametrize("k", [1, 3, 6])
def test_kmers_and_ids(spark, k):
    ids = {"".join(p): i + 2 for i, p in enumerate(product("ACGT", repeat=k))}
    assert column(spark, kmers.split(F.col("s"), k)) == [pieces(s, k) for s in SEQUENCES]
    assert column(spark, kmers.text(F.col("s"), k)) == [" ".join(pieces(s, k)) for s in SEQUENCES]
    for encode in (kmers.encode, kmers.encode_by_row):
        assert column(spark, encode(F.col("s"), k)) == [[ids.get(m, 1) for m in pieces(s, k)] for s in SEQUENCES]
    vocabulary = {r.token: r.token_id for r in features.vocabulary(spark, k).collect()}
    assert vocabulary == {"<PAD>": 0, "<UNK>": 1} | ids
    assert [r.kmer for r in features.all_kmers(spark, k).orderBy("kmer_index").collect()] == list(ids)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6, 7, 12, 16])
def test_ids_of_a_batch_equal_those_by_row(spark, k):
    rng = random.Random(k)
    made = ["".join(rng.choices("ACGTNacgtÄ日", [9, 9, 9, 9, 1, 0.2, 0.2, 0.2, 0.2, 0.5, 0.5], k=rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in [None, "", *made, "ACGT" * 9, None]], "s string").coalesce(1)
    rows = df.select(kmers.encode(F.col("s"), k).alias("a"), kmers.encode_by_row(F.col("s"), k).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_large_vocabulary_ids_do_not_overflow(spark):
    k = 16
    row = spark.createDataFrame([("T" * k,)], "s string").select(kmers.encode(F.col("s"), k).alias("v")).first()
    assert row.v == [4**k + 1]


def test_nucleotides(spark):
    found = column(spark, kmers.nucleotides(F.col("s"), "null"))
    assert found[0] == [] and found[1] == [0, 1, 2] and found[5][:5] == [0, 1, 2, None, 0]
    with pytest.raises(Exception, match="not a nucleotide"):
        column(spark, kmers.nucleotides(F.col("s")))
    clean = table(spark).where("s rlike '^[ACGT]*$'").select(kmers.nucleotides(F.col("s")).alias("v"))
    assert clean.count() == 5


def test_padding(spark):
    ids = kmers.encode(F.col("s"), 3)
    for n in (0 + 1, 4, 20):
        padded, mask = column(spark, kmers.pad(ids, n)), column(spark, kmers.mask(ids, n))
        for s, p, m in zip(SEQUENCES, padded, mask):
            real = min(len(pieces(s, 3)), n)
            assert len(p) == len(m) == n and m == [1] * real + [0] * (n - real) and p[real:] == [0] * (n - real)


def test_model_columns(spark):
    df = spark.createDataFrame([("ACGTACGT", 1)], "query_subseq string, labels bigint")
    tokens = features.tokenized(features.to_model_columns(df), 6, 4)
    assert tokens.columns == ["sequence", "label", "input_ids", "attention_mask"]
    assert dict(tokens.dtypes)["label"] == "int" and tokens.first().attention_mask == [1, 1, 1, 0]
    assert features.with_kmer_ids(df, 6).first().input_ids[0] == 0 * 4**5 + 1 * 4**4 + 2 * 4**3 + 3 * 4**2 + 1 + 2


def test_map_batches(spark):
    def lengths(batch):
        return batch.assign(n=batch["s"].str.len())[["id", "n"]]

    found = features.map_batches(table(spark), lengths, "id bigint, n bigint").collect()
    assert {r.id: r.n for r in found} == {i: len(s) for i, s in enumerate(SEQUENCES)}


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_letters_of_a_batch():
    rng = random.Random(3)
    pairs = [("", ""), ("", "A"), ("é😀a" * 30, "é😀" * 40)]
    for n in (1, 5, 50, 63, 64, 65, 127, 128, 129, 300) * 6:
        a = "".join(rng.choices("ACGT", k=n))
        other = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(n)
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "GG"])
        pairs += [(a, "".join(other)), ("".join(rng.choices("ACGT", k=rng.randint(0, 140))), a)]
    expected = np.array([lcs_table(a, b) for a, b in pairs])
    assert lcs_lengths(*zip(*pairs, strict=True)).tolist() == expected.tolist()
    for edits in (0, 2, 30):
        need = np.array([max(len(a), len(b)) - edits for a, b in pairs])
        assert lcs_lengths(*zip(*pairs, strict=True), need).tolist() == np.where(expected >= need, expected, -1).tolist()
    assert lcs_lengths([], []).tolist() == []


def test_similarity(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choices("ACGTN", k=rng.randint(0, 150))) for _ in range(40)] + ["", "A"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id bigint, query_subseq string")
    for limit in (30, len(seqs), 100):
        found = {(r.i, r.j): r.score for r in similarity.pairwise(df, ["id"], limit=limit).collect()}
        n = min(limit, len(seqs))
        assert len(found) == n * n
        for i in range(n):
            for j in range(n):
                longest = max(len(seqs[i]), len(seqs[j]))
                expected = lcs_table(seqs[i], seqs[j]) / longest if longest else None
                assert found[i, j] == pytest.approx(expected)
    plan = plan_of(similarity.pairwise(df, ["id"], limit=50))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(50)) for _ in range(25)]
    sequences = [*base, "", "A", "AC", "CA", "ACGTA", "GTACG", "A" * 50, "A" * 48 + "CC", None, base[0]]
    for s in base:
        for edits in (1, 1, 2, 3):
            letters = list(s)
            for _ in range(edits):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice(["", rng.choice("ACGT"), letters[at] + rng.choice("ACGT")])
            sequences.append("".join(letters))
    df = spark.createDataFrame([(s,) for s in sequences], "query_subseq string")
    known = sorted({s for s in sequences if s is not None})
    expected = {}
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            common, longer = lcs_table(a, b), max(len(a), len(b))
            if longer - common <= 2:
                expected[a, b] = common / longer
    found = [tuple(r) for r in similarity.near_pairs(df, edits=2).collect()]
    assert len(found) == len(expected) and {(a, b): s for a, b, s in found} == pytest.approx(expected)


def test_ids_and_their_counts_are_made_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGTNé", k=rng.randint(0, 40))) for _ in range(200)] + [None, "", "ACG"]
    whole = kmers.ids_of(pa.array(texts), 3).to_pylist()
    monkeypatch.setattr(kmers, "BLOCK_BYTES", 64)
    column = pa.array(["x", *texts])[1:]
    assert kmers.ids_of(column, 3).to_pylist() == whole and kmers.ids_of(pa.array([], pa.string()), 3).to_pylist() == []
    assert max(len(ids) for ids, _ in kmers.id_blocks(column, 3)) <= 64
    df = spark.createDataFrame([(t,) for t in texts], "query_subseq string")
    counted = {r.token_id: r.n for r in features.kmer_id_counts(df, 3).collect()}
    assert counted == Counter(i for ids in whole for i in ids)


def test_a_letter_changes_few_bits_of_a_signature():
    rng = random.Random(3)
    for letters in ("ACGT", "ACGTNé𝄞"):
        for n in (0, 1, 2, 3, 50, 80):
            text = "".join(rng.choices(letters, k=n))
            for at in range(n + 1):
                more = text[:at] + rng.choice(letters) + text[at:]
                a, b = run_signatures([text, more]).tolist()
                assert ((a ^ b) & (2**64 - 1)).bit_count() <= BITS_PER_LETTER


def test_near_pairs_shuffle_only_pieces_and_near_pairs(spark):
    """Pairs are scored below the exchange that makes them distinct, and a sequence has few pieces."""
    rng = random.Random(6)
    sequences = ["".join(rng.choices("ACGT", k=50)) for _ in range(400)] + ["".join(rng.choices("ACGT", k=52)) for _ in range(400)]
    plan = plan_of(similarity.near_pairs(spark.createDataFrame([(s,) for s in sequences], "query_subseq string")))
    tree = plan.split("\n\n")[0]
    assert tree.index("HashAggregate") < tree.index("Exchange") < tree.index("ArrowEvalPython") < tree.index("Join")


def test_a_letter_changes_few_bits_of_a_signature_of_four():
    rng = random.Random(4)
    for letters in ("A", "ACGT", "ACGTNé𝄞"):
        for n in (0, 1, 3, 4, 5, 50, 80):
            text = "".join(rng.choices(letters, k=n))
            for at in range(n + 1):
                more = text[:at] + rng.choice(letters) + text[at:]
                a, b = four_signatures([text, more]).view(np.uint64)
                assert np.bitwise_count(a ^ b).sum() <= BITS_PER_LETTER_OF_FOUR


def test_pairs_of_unlike_sequences_under_one_key_go_no_further(monkeypatch):
    """Hundreds of sequences share a piece: only the near pairs among them are left, each once."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("ACGT", k=50)) for _ in range(300)]
    texts = [t[:20] + "ACGTTGCAAC" + t[30:] for t in texts]
    texts += [t[:5] + "A" + t[6:] for t in texts[:20]]
    n = len(texts)
    signed = Signed(np.full(n, 9), np.arange(n), np.zeros(n, np.int8), list(four_signatures(texts).view(np.uint64).T))
    empty = signed.take(np.zeros(0, np.int64))
    for pairs in (1 << 20, 100):
        monkeypatch.setattr(similarity_functions, "GROUP_PAIRS", pairs)
        found = [(i, j) for a, b in like_pairs(signed, signed, 2) for i, j in zip(b.tolist(), a.tolist(), strict=True)]
        assert len(found) == len(set(found)) <= 40 and all(i < j for i, j in found)
        assert set(found) >= {(k, 300 + k) for k in range(20)}
    assert not list(like_pairs(empty, signed, 2)) and not list(like_pairs(signed, empty, 2))


def test_near_pairs_with_a_common_piece_are_dealt_out(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ACGT", k=20)) + "ACGTTGCAAC" + "".join(rng.choices("ACGT", k=20)) for _ in range(60)]
    texts += [t[:k % 45] + rng.choice("ACGT") + t[k % 45 + 1 :] for k, t in enumerate(texts)] + [t + "GA" for t in texts[:10]]
    df = spark.createDataFrame([(t,) for t in texts], "query_subseq string")
    whole = sorted(map(tuple, similarity.near_pairs(df).collect()))
    monkeypatch.setattr(similarity, "COMMON", 10)
    monkeypatch.setattr(similarity, "BUCKET_PIECES", 40)
    assert sorted(map(tuple, similarity.near_pairs(df).collect())) == whole
    known = sorted(set(texts))
    expected = [(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if max(len(a), len(b)) - lcs_table(a, b) <= 2]
    assert [(a, b) for a, b, _ in whole] == expected
