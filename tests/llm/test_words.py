"""Word BPE against the library, divergence and spelling variants against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fitspark.llm import rank_bpe, variants
from fitspark.llm.divergence import source_divergence
from fitspark.llm.queries import op11_word_bpe, op13_variants
from fitspark.llm.rank_bpe import Words, word_bpe_round_trip
from fitspark.llm.runs import latin_bytes, runs, summed, term_bytes

D = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def words():
    return Words(PATH)


def hostile():
    r = random.Random(1)
    letters = [*"aabbccde'strevmld  \t\n<|>endoftextstartoftext.,!?0123ÄÖÜßéÉΣςσİıǅ中文א", *map(chr, (0x301, 0x308, 0x345, 0x1C, 0x1F, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x11DE0, 0x1C89, 0x1100, 0x1161, 0x110B9, 0x110BA, 0x1D15E, 0x212B, 0x1AC3, 0x898))]
    out = ["".join(r.choices(letters, k=r.randrange(60))) for _ in range(3000)]
    code = lambda: r.choice([r.randrange(0x20, 0x3000), r.randrange(0x20, 0x250), r.randrange(0x300, 0x370), r.randrange(0x1E00, 0x2000), r.randrange(0x10000, 0x1F000)])
    out += ["".join(chr(code()) for _ in range(30)) for _ in range(3000)]
    out += ["x<|endoftext|>y <|startoftext|>", "<|endoftext|><|endoftext|>", "<|endofte<|endoftext|>xt|>", "", " ", "x" * 5000, "ab" * 3000 + " " + "é" * 700, "".join(r.choices("abcdefghij", k=20_000))]
    return out


def test_ids_and_decoding_equal_the_library(words, library):
    texts = hostile()
    for text, (ids, decoded), want in zip(texts, words.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids == " ".join(map(str, want.ids)), text[:100]
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_short_and_long_words_merge_alike(words, monkeypatch):
    r = random.Random(2)
    some = ["".join(r.choices("aeinrst", k=r.randrange(1, 60))) for _ in range(300)] + ["a" * n for n in range(1, 40)]
    short = words.merged([words.symbols(w.encode()) for w in some])
    assert [words.merged_long(words.symbols(w.encode())) for w in some] == short
    monkeypatch.setattr(words, "ordered", False)
    assert [words.merged_long(words.symbols(w.encode())) for w in some] == short


def test_forgetting_changes_nothing(words, monkeypatch):
    texts = [f"word{i % 50} other{i}, more." for i in range(300)]
    want = [words.encode(t) for t in texts]
    monkeypatch.setattr(rank_bpe, "KEPT", 20)
    words.forget()
    assert [words.encode(t) for t in texts] == want and len(words.ids_of) < 60


def test_query_equals_the_library_on_whole_documents(spark, docs, library):
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        want[r.doc_id] = (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in op11_word_bpe(spark, D).collect()} == want


def test_round_trip_of_edge_rows(spark, edge, empty, library):
    got = sorted(map(tuple, word_bpe_round_trip(edge, PATH, with_ids=True).select("doc_id", "n_tokens", "ids").collect()), key=repr)
    texts = [(r.doc_id, r.text or "") for r in edge.select("doc_id", "text").collect()]
    assert got == sorted(((i, len(e.ids), e.ids) for (i, _), e in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False))), key=repr)
    assert word_bpe_round_trip(empty, PATH).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="another kind"):
        Words(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["Alpha beta, ALPHA\n1a2b", "", "Éa éA x", "a", "中文 ab", "\x7fa\x80b", "x" * 70_000 + " y", "end"]


@pytest.mark.parametrize("cut", [0, 2])
def test_runs_equal_the_patterns(cut):
    texts = pa.array(TEXTS)[cut:]
    for inside, pattern in ((term_bytes, "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), (latin_bytes, "[A-Za-zÀ-ÿ]+")):
        found, rows = runs(texts, inside)
        assert list(zip(found.to_pylist(), rows.tolist())) == [(w.encode().lower().decode(), i) for i, t in enumerate(TEXTS[cut:]) for w in re.findall(pattern, t)]
    assert len(runs(pa.array([], pa.string()), term_bytes)[0]) == 0


def test_sums_go_out_when_too_many_are_held():
    tables = [pa.table({"k": [f"k{(i * 7 + j) % 40}" for j in range(30)], "n": [1] * 30}) for i in range(20)]
    for most in (10, 35, 1000):
        total = Counter()
        for b in summed(iter(tables), ["k"], ["n"], held_rows=most):
            total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        assert sum(total.values()) >= 40 and (most < 1000 or sum(total.values()) == 600)


def plain_divergence(rows, min_docs, top):
    words, groups, seen = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [w.encode().lower().decode() for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        words[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)

        def share(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        p = {s: share(words[lang, s]) for s in sources}
        q = share(sum((words[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if words[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "n_sources"), [(1, 3), (3, 9), (1000, 4)])
def test_divergence_equals_plain_loops(spark, min_docs, n_sources):
    r = random.Random(n_sources)
    vocabulary = [f"w{chr(97 + i)}" for i in range(26)] + ["É", "é", "ß中"]
    rows = [(" ".join(r.choices(vocabulary[: r.choice([3, 10, 29])], k=r.randrange(12))), r.choice(["en", "en", "en", "de", None]), f"s{min(r.randrange(n_sources), r.randrange(n_sources))}") for _ in range(300)]
    rows += [(None, "fr", None), ("", "fr", "only"), (None, None, None), ("WA wa", "en", "s0")] + [("wa wb", "en", "s1")] * 20
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit(1), "term": F.lit("x"), "docs": F.lit(2)})
    got = source_divergence(df, min_docs=min_docs, top=5)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, min_docs, 5)


def test_divergence_of_edge_rows(spark, edge, empty):
    rows = [(r.text, r.lang, r.source) for r in edge.select("text", "lang", "source").collect()]
    assert sorted(map(tuple, source_divergence(edge, min_docs=1).collect())) == plain_divergence(rows, 1, 50)
    assert source_divergence(empty).count() == 0


def plain_variants(docs):
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 5:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    near = plain_near(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def plain_near(words):
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    return near


def test_variants_equal_plain_loops_on_whole_documents(spark, docs):
    got = op13_variants(spark, D)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain_variants((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_variants_of_edge_rows(spark, edge, empty):
    assert sorted(map(tuple, variants.spelling_variants(edge).collect())) == plain_variants((r.doc_id, r.text) for r in edge.select("doc_id", "text").collect())
    assert variants.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("block", [2, 6, 10_000])
def test_every_near_pair_is_found_once_whatever_the_blocks(spark, block):
    r = random.Random(block)
    some = {"".join(r.choices("ab", k=r.randrange(1, 9))) for _ in range(200)} | {"".join(r.choices("abcé", k=r.randrange(4, 7))) for _ in range(200)}
    some |= {"x" * n for n in range(1, 30)} | {"hub" + c for c in "abcdefghijklmnopqrstuvwxyzéü"} | {"l" * 300, "l" * 301, "l" * 150 + "m" + "l" * 149}
    got = sorted(tuple(sorted(p)) for p in variants.near_words(spark.createDataFrame([(w, 3) for w in some], "word string, n long"), block=block).collect())
    near = plain_near(some)
    assert got == sorted((a, b) for a in some for b in near[a] if a < b)


def test_blocks_are_bounded_however_many_words_share_a_beginning(spark):
    r = random.Random(9)
    some = {"commonbeginning" + "".join(r.choices("abcdefgh", k=7)) for _ in range(3000)}
    blocks = variants.blocks_of(spark.createDataFrame([(w,) for w in some], "word string"), block=40)
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] <= 40


def test_checksums_of_short_and_long_runs():
    found, rows = runs(pa.array(["ab cd", "é" * 100 + " " + "q" * 500]), latin_bytes)
    want = [zlib.crc32(p + w.encode()) for p, w in zip((b"1:", b"1:", b":", b":"), found.to_pylist())]
    assert variants.checksums(found, rows, [b"1:", b":"]).tolist() == want and rows.tolist() == [0, 0, 1, 1]


def test_forms_are_followed_to_the_end(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")], "word string, form string")
    assert {r.word: r.root for r in variants.followed(links).collect()} == {f"w{i}": "w37" for i in range(37)} | {"x": "w37"}
    assert variants.followed(links.limit(0)).count() == 0
