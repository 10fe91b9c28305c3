import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scenespark.llm import lines, mixing, packing, partenum, tokens
from scenespark.llm._encoders import PieceCounter, WordEncoder
from scenespark.llm._text import shingles
from scenespark.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, source string, n_lines string, size long, start string, component_id string"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 7, "y", "z") for i, t, s in rows], SCHEMA)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def sets_of(docs):
    out = {}
    for i, t in docs:
        w = words(t)
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(docs):
    s, up = sets_of(docs), {i: i for i, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(s[a] & s[b])
            if n and 100 * n >= 80 * len(s[a] | s[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i)) for i in ids}


def near_docs():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    docs, base = [], [[word() for _ in range(n)] for n in (3, 5, 9, 14, 40, 41, 120, 400)]
    passage = [word() for _ in range(40)]
    for k, b in enumerate(base):
        for j in range(14):
            w = list(b)
            for _ in range(j * len(b) // 60):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    docs += [" ".join([word() for _ in range(60)] + passage) for _ in range(40)]  # one passage in many texts
    docs += ["", None, " \t\n ", "One", "one", "ONE two", "a\x1cb", "é " * 9, "É " * 9]
    return list(enumerate(docs))


def test_jaccard_join_equals_brute_force(spark):
    docs = near_docs()
    got = partenum.jaccard_components(table(spark, [(i, t, "s") for i, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_jaccard_hubs_lose_no_link(spark, monkeypatch):
    """A chain of texts: each is like its neighbours, not like the hub of their common signatures."""
    base = [f"w{i}" for i in range(400)]
    docs = []
    for k in range(30):
        w = list(base)
        w[: 6 * k] = [f"x{i}" for i in range(6 * k)]
        docs.append((k, " ".join(w)))
    got = partenum.jaccard_components(table(spark, [(i, t, "s") for i, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def crowded():
    """Two like texts, first, and 60 that are like nothing; of the parts that the two share each is in
    many of the others. Texts come with the largest keys first: hubs are among the last."""
    import pyarrow as pa

    rng = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    fillers = [base[:i] + [f"f{k}x{j}" for j in range(6)] + base[i + 6 :] for k in range(60) for i in [rng.randrange(33)]]

    def by_key(texts):
        texts = [" ".join(t) for t in texts]
        flat, at = shingles(pa.array(texts))
        keys = partenum.mix(partenum._sum(flat, at) + np.diff(at).astype(np.uint64)).view(np.int64)
        return [texts[i] for i in np.argsort(keys)[::-1]]

    return by_key([base[:-1] + [f"p{i}"] for i in range(1000)])[:2] + by_key(fillers)


def test_jaccard_hub_with_a_large_id(spark):
    docs = list(enumerate(crowded()))
    want = brute_components(docs)
    assert {i for i, (_, c) in want.items() if c != i} == {1}
    got = partenum.jaccard_components(table(spark, [(i, t, "s") for i, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("order", range(4))
def test_jaccard_template_families(spark, monkeypatch, order):
    """Two like texts (0.88) whose shared signatures are all in the large groups of 80 others with the
    same 300 words, in several orders of ids and in small blocks."""
    monkeypatch.setattr(partenum, "BLOCK", 7)
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join(common + [f"p{k}x{j}" for j in range(20)]) for k in range(2)] + [" ".join(common + [f"q{k}x{j}" for j in range(104)]) for k in range(80)]
    ids = list(range(82)) if not order else np.random.default_rng(order).permutation(82).tolist()
    docs = list(zip(ids, texts))
    want = brute_components(docs)
    got = partenum.jaccard_components(table(spark, [(i, t, "s") for i, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert want[max(ids[:2])][1] == min(ids[:2])


def test_jaccard_random_families(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 9)
    rng = random.Random(11)
    docs = []
    for family in range(5):
        common = [f"c{family}x{i}" for i in range(rng.randrange(40, 200))]
        for _ in range(40):
            w = list(common)
            for _ in range(rng.randrange(len(w) // 12)):
                w[rng.randrange(len(w))] = f"r{rng.randrange(10**6)}"
            docs.append(" ".join(w + [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = partenum.jaccard_components(table(spark, [(i, t, "s") for i, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_jaccard_repeated_ids(spark):
    """Rows of one id are one document: 1, 2 and 3 link through the two texts of 2."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a + " x"), (2, a), (2, b), (3, b + " y"), (4, "else"), (4, "else")]
    got = partenum.jaccard_components(table(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_jaccard_like_sets_of_one_hub_give_few_pairs():
    import pandas as pd

    rng = np.random.default_rng(2)
    sets = [np.arange(i, i + 100) for i in range(8)] + [np.arange(5000, 5100)]
    flat = partenum.mix(np.concatenate(sets).astype(np.uint64))
    nodes = rng.permutation(9)
    one = pd.DataFrame({"node": nodes, "comp": nodes, "n": 100, "sketch": partenum._sketches(flat, np.arange(0, 901, 100)), "out": nodes != nodes[8]})
    pdf = pd.concat((one[one["out"]].assign(side=0), one.assign(side=1)))
    got = partenum._across(pdf, 0.8, False)
    assert got["pair"].sum() == 7 and set(got["a"][~got["pair"]]) == set(nodes[:8])
    assert len(partenum._across(pdf, 0.8, True)) == 28


def test_jaccard_hub_without_an_id(spark):
    docs = list(enumerate(crowded()))
    want = brute_components(docs[:40])
    got = partenum.jaccard_components(table(spark, [(i if i < 40 else None, t, "s") for i, t in docs])).where("doc_id is not null").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_odd_rows(spark):
    df = table(spark, [(None, "a b c d e f", "s"), (4, "a b c d e f", "s"), (4, "a b c d e f", "s"), (2, "A b c d e F", None)])
    assert sorted((r.doc_id or -1, r.component_id) for r in partenum.jaccard_components(df).collect())[1:] == [(2, 2), (4, 2), (4, 2)]
    assert partenum.jaccard_components(df.limit(0)).count() == 0


def test_shingles_count():
    import pyarrow as pa

    texts = [t for _, t in near_docs()]
    _, at = shingles(pa.array(texts, pa.string()).slice(3))
    want = [len(s) for s in sets_of(list(enumerate(texts[3:]))).values()]
    assert np.diff(at).tolist() == want


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == i]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    long, edge = "This line has many characters and stands in many texts", "é" * 40
    docs = [(i, "\n".join([f"own {i}", f" {long.upper() if i % 2 else long}\r", edge if i < 5 else edge[1:], "short"] + [long] * (i % 3))) for i in range(9)]
    docs += [(20, None), (21, ""), (22, "\n\n"), (23, "x" * 100_000 + "\n" + "y" * 50)]
    got = lines.dedup_lines(table(spark, [(i, t, None) for i, t in docs]))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(docs)
    assert got.columns[-2:] == ["n_lines", "n_dropped"]
    assert lines.dedup_lines(table(spark, []) if False else got.limit(0)).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    long = "z" * 41
    rows = [(None, long, "s")] * 6 + [(1, long, "s")] * 6
    got = lines.dedup_lines(table(spark, rows)).collect()
    assert all(r.text == long and r.n_dropped == 0 for r in got) and len(got) == 12


def test_token_counts_equal_the_library(spark, sf, tmp_path):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    odd = ["", None, " ", "  a  b ", "a\tb\n\nc", "▁x", "<s> </s> <unk>", "a b ́c", "x" * 50_000, "日本語 テキスト", "a b " * 3000, "  a", "a \n b"]
    docs += list(enumerate(odd, 10_000)) + [(None, "a b"), (10_000, "again")]
    df = table(spark, [(i, t, None) for i, t in docs])
    want = sorted((i or -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in docs)
    for _ in range(2):  # the second time every text is in the cache
        got = tokens.count_tokens(df, path, cache_path=f"file://{tmp_path}/cache").collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    cached = spark.read.parquet(f"file://{tmp_path}/cache")
    assert cached.count() == cached.select("digest").distinct().count() == len({t or "" for _, t in docs})
    assert tokens.count_tokens(df.limit(0), path).count() == 0


def test_memo_encoders_on_random_text():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    sp, tk = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    mine, enc = PieceCounter(tokenizer_path("piece_bpe_32k.model")), WordEncoder(tokenizer_path("word_bpe_49k.json"))
    assert mine.alone
    rng = random.Random(2)
    alphabet = list("abcAB  \n\t'.,!12Éßİſéàïœñ́ \x1c\x85▁日<|>") + ["'s", "'LL", "<|endoftext|>", "%%%", " the ", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert mine.count(texts) == [len(sp.encode(t)) for t in texts]
    flat, at = enc.encode([t.encode() for t in texts])
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert flat[a:b].tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_targets_and_fit():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.fill_targets([], [], 0, 2) == [] and mixing.fill_targets([0, 4], [5, 2], 6, 2) == [0.0, 6.0]
    rng = np.random.default_rng(0)
    for budget in (0, 7, 555, 40_000, 999_999):
        n, c = np.arange(1, 1500, 3), rng.integers(0, 9, 500)
        take = mixing.fit(n, c, budget, 1)
        assert (take >= 0).all() and (take <= c).all() and int((n * take).sum()) == budget
    assert mixing.fit(np.array([100]), np.array([1]), 30, 1).tolist() == [0]
    assert mixing.fit(np.array([100]), np.array([1]), 70, 1).tolist() == [1]
    assert mixing.fit(np.array([10**6]), np.array([7]), 3_400_000, 1).tolist() == [3]


def check_mix(docs, got):
    size = Counter()
    for i, t, s in docs:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.fill_targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()), 2)))
    by_id, taken = {i: (t, s) for i, t, s in docs}, Counter()
    for r in got:
        t, s = by_id[r.doc_id]
        assert r.size == len(words(t)) and r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    return target, taken


def test_mixing(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs += [(5000, None, "src1"), (5001, "", None), (5002, "a b c", None), (5003, "", "empty")]
    df = table(spark, docs)
    got = mixing.mix(df).collect()
    assert len(got) == len(docs)
    target, taken = check_mix(docs, got)
    assert all(abs(target[s] - taken[s]) <= max(1, 0.002 * target[s]) for s in target if s not in (None, "empty")), (target, taken)
    assert sorted(got) == sorted(mixing.mix(df.repartition(3)).collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_copies_and_null_ids(spark):
    docs = [(None, "a b c d", "s")] * 30 + [(i, "a b", "t") for i in range(50)] + [(99, "x y", "t")] * 3
    got = mixing.mix(table(spark, docs)).collect()
    assert len(got) == 83 and abs(sum(r.taken for r in got) - 1.5 * (120 + 106)) <= 4


def test_plain_words_go_to_the_model_alone():
    """Words of Latin letters, digits and signs do not pass the file's normaliser and pattern again."""
    enc, rng = WordEncoder(tokenizer_path("word_bpe_49k.json")), random.Random(5)
    signs = [chr(c) for c in (*range(0x21, 0x27), *range(0x28, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))]
    texts = [t for t in (" ".join("".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(40)) for _ in range(200)) if "<|" not in t]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    enc.tokenizer = None
    ids, at = enc.encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_pack_histogram_places_all():
    rng = random.Random(1)
    h = Counter(rng.randint(1, 4096) for _ in range(3000))
    found, used, space = Counter(), 0, 0
    for count, lengths in packing.pack_histogram(dict(h), 4096):
        assert sum(lengths) <= 4096 and count > 0
        for n in lengths:
            found[n] += count
        used, space = used + count * sum(lengths), space + count * 4096
    assert found == h and used / space > 0.97
    assert packing.pack_histogram({}, 4096) == []


def test_packing_is_an_exact_cover(spark, sf):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(9000, None), (9001, ""), (9002, "one two " * 9000), (9003, "a<|endoftext|>b c'S D'LL ﬁ É"), (9004, "x" * 30_000)]
    got = packing.pack(table(spark, [(i, t, None) for i, t in docs]), tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert list(r.ids) == own and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, p in pieces.items():
        assert sum(n for _, n in p) == len(ids[i]) and [s for s, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]
    for p in sequences.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(table(spark, [(1, "a", None)]).limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("lengths, counts, budget, want", [([300_000], [1], 270_000, 300_000), ([10**6], [7], 3_600_000, 4_000_000), ([10, 300_000], [5, 1], 270_000, 300_050), ([10, 300_000], [5, 1], 100_000, 50)])
def test_fit_takes_a_document_beyond_the_window(lengths, counts, budget, want):
    take = mixing.fit(np.array(lengths), np.array(counts), budget, 42)
    assert (take <= counts).all() and int((take * lengths).sum()) == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))
    assert len(got) and rows(got) == rows(want)
