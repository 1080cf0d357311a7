"""Language identification, byte-level BPE and line dedup against held-out labels, a public library and plain loops."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex
import tiktoken
import zstandard
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, line_dedup

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "Hello world's  end\n\n  next", "été naïve ÉCOLE 東京 🎉🎉", "a" * 5000, "ab" * 3000, "x\x00y​́", "<|endoftext|> plain", "1234567 12 3", "\r\n\t tabs\t", "😀" * 400, "don't DON'T we'll"]


@pytest.fixture(scope="module")
def public():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_digests_match_the_public_library(spark, public, small_dir):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = rows.select("doc_id", bpe.encode(F.col("text"), PATH, public_tokenizers.PATTERN).alias("ids"), bpe.digests(F.col("text"), PATH, public_tokenizers.PATTERN).alias("d")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = public.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == want
        assert r["d"]["n_tokens"] == len(want) and r["d"]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["d"]["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_random_bytes_edits_and_appends(public):
    known, draw = bpe.vocabulary(PATH, public_tokenizers.PATTERN), random.Random(3)
    encode = lambda data: public._core_bpe.encode_single_piece(data)
    some = lambda n: bytes(draw.choice(b"the anding \xc3\xa9\xff\n0 ") for _ in range(n))
    for _ in range(60):
        table = bpe.Prefixes(known, some(draw.randint(1, 80)))
        for _ in range(4):
            a = draw.randint(0, len(table.data))
            b = draw.randint(a, len(table.data))
            table.splice(a, b, some(draw.randint(0, 9)))
            table.append(some(draw.randint(1, 5)))
            fresh = bpe.Prefixes(known, table.data)
            assert table.last == fresh.last and table.ids() == fresh.ids()
            assert known.decode(table.ids()) == table.data
            if table.data not in known.ranks:
                assert table.ids() == encode(table.data)


def test_held_out_languages(spark, medium_dir):
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet")
    rows = langid.identify(docs).toPandas()
    held = rows[rows["held_out"] & rows["lang"].notna() & (rows["lang_pred"] != "und")]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert rows["score"].between(0, 1).all() and set(rows["lang_pred"]) <= {*docs.toPandas()["lang"].dropna(), "und"}
    assert set(rows.columns) == {*docs.columns, "held_out", "lang_pred", "score", "rejected"}


def test_languages_match_a_plain_loop(spark, medium_dir):
    """Dictionaries of the excerpts with the smallest hashes, and predictions, by a loop over the rows."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{medium_dir}/documents.parquet").collect()]
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2] is not None]
    options = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    plain = lambda text: regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip().encode() if regex.search(r"\p{L}", text) else b""
    packers, seen = {}, Counter(r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2)
    for lang in {r[2] for r in learn}:
        hashed = sorted((int(hashlib.md5(f"5:{d}".encode()).hexdigest()[:15], 16), d, t) for d, t, x in learn if x == lang)[:192]
        parts = sorted((k, t[k % (max(len(t) - 1200, 0) + 1) :][:1200]) for k, _, t in hashed)
        content = zstandard.ZstdCompressionDict(b" ".join(plain(t) for _, t in parts), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[lang] = zstandard.ZstdCompressor(compression_params=options, dict_data=content)
    want = {}
    for d, text, _ in rows:
        data = plain(text or "")
        sizes = sorted((sum(len(p.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), -seen[x], x) for x, p in packers.items())
        want[d] = (sizes[0][2], min(1.0, 4 * (1 - sizes[0][0] / sizes[1][0]))) if data else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.read.parquet(f"{medium_dir}/documents.parquet")).collect()}
    assert got.keys() == want.keys() and all(got[d][0] == want[d][0] and got[d][1] == pytest.approx(want[d][1]) for d in want)


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score string"
    en, fr = "the cat and the dog went over the hill " * 20, "le chat et le chien sont sur la colline " * 20
    learn = [(i, f"{en} {i}", "en", "") for i in range(30)] + [(i + 30, f"{fr} {i}", "fr", "") for i in range(30)]
    odd = [(100, None, "en", ""), (101, "", None, ""), (102, "123 ½ ² ① !!! ́", "fr", ""), (None, en, None, ""), (103, en * 500, None, ""), (103, en * 500, None, "")]
    got = defaultdict(list)
    for r in langid.identify(spark.createDataFrame(learn + odd, schema)).collect():
        got[r["doc_id"]].append(r)
    assert {got[i][0]["lang_pred"] for i in (100, 101, 102)} == {"und"} and all(got[i][0]["rejected"] for i in (100, 101, 102))
    assert got[None][0]["lang_pred"] == "en" and [r["lang_pred"] for r in got[103]] == ["en", "en"]
    assert got[35][0]["lang_pred"] == "fr" and isinstance(got[35][0]["score"], float)
    hot = [(7, f"{en} {i}", "en", "") for i in range(400)] + [(8, en, "en", "")] * 400
    assert len(langid.fit(spark.createDataFrame(hot, schema).repartition(4)).dictionaries["en"]) <= 192 * 1201
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(odd[1:2] + odd[4:5], schema)).collect()} == {"und"}


def brute_lines(rows, share, least):
    strip = lambda x: x.strip(" \t\r")
    total, on = defaultdict(int), defaultdict(int)
    for _, host, text in rows:
        if host is not None:
            total[host] += 1
            for line in {strip(x) for x in (text or "").split("\n")} - {""}:
                on[host, line] += 1
    out = []
    for page, host, text in rows:
        if text is None or host is None:
            out.append((page, host, text, 0))
            continue
        lines = text.split("\n")
        left = [x for x in lines if not (strip(x) and on[host, strip(x)] >= least and on[host, strip(x)] > share * total[host])]
        out.append((page, host, "\n".join(left), len(lines) - len(left)))
    return sorted(out, key=str)


def test_boilerplate_matches_brute_force(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["a", "a", "b", "c", None]), "\n".join(draw.choice(["nav", " nav\t", "", "  ", f"own {draw.randint(0, 40)}", "rare"]) for _ in range(draw.randint(0, 6)))) for i in range(300)]
    rows += [(300, "lone", "x\nx\ny"), (301, "a", None), (302, "a", "nav"), (302, "a", "nav"), (303, None, "nav")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, host string, text string, line string").repartition(5)
    for share, least in ((0.2, 2), (0.0, 3), (0.9, 2)):
        got = line_dedup.drop_boilerplate(frame, share=share, pages_least=least).collect()
        assert sorted(((r["page_id"], r["host"], r["text"], r["lines_dropped"]) for r in got), key=str) == brute_lines(rows, share, least)
        assert {r["line"] for r in got} == {"clash"}


def test_hosts_and_page_texts(spark):
    row = spark.sql("select 'HTTPS://u:p@Blog.Example.com:80/x?y' as u, 'not a url' as v, '<!--a\n--><ScRipt>x</script ><p>One <b>two</b></p>\n\n<p>3&amp;4</p>' as h")
    got = row.select(line_dedup.host_of(F.col("u")).alias("a"), line_dedup.host_of(F.col("v")).alias("b"), line_dedup.page_text(F.col("h")).alias("t")).first()
    assert (got["a"], got["b"]) == ("blog.example.com", None)
    assert [x.strip() for x in got["t"].split("\n") if x.strip()] == ["One two", "3&amp;4"]


def test_no_lines(spark):
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "page_id long, host string, text string")).collect() == []


def test_odd_texts_in_encoding(spark, public):
    docs = spark.createDataFrame([(1, "clash " * 90_000, "x"), (2, None, "x"), (2, None, "x")], "doc_id long, text string, ids string")
    got = docs.select("*", bpe.digests(F.col("text"), PATH, public_tokenizers.PATTERN).alias("d")).collect()
    assert sorted(r["d"]["n_tokens"] for r in got) == [0, 0, len(public.encode_ordinary("clash " * 90_000))]
    assert docs.limit(0).select(bpe.encode(F.col("text"), PATH, public_tokenizers.PATTERN)).collect() == []


def test_long_lines_and_pages(spark):
    long = "\n".join(f"line {i} {'x' * 50}" for i in range(20_000))
    rows = [(i, "h", f"{long}\n{'y' * 500_000}\nown {i}") for i in range(2)] + [(9, "h", "own 9")]
    got = {r["page_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, host string, text string, lines_dropped int")).collect()}
    assert got == {0: "own 0", 1: "own 1", 9: "own 9"}


def test_new_pieces_are_encoded_together(public, monkeypatch):
    """A short piece has no table of its own, however many are new; bounds of any size give the same ids."""
    draw, tables = random.Random(5), []
    parts = ["the", "and", "ción", "ß", "qu", "é", "x", "東京", "ing", "😀", "ы"]
    texts = ["", *[" ".join("".join(draw.choices(parts, k=draw.randint(1, 9))) for _ in range(draw.randint(0, 400))) for _ in range(60)], "é" * 128, "é" * 128 + "x", "", "\0 \0\0a", "the " * 700]
    made = bpe.Prefixes.__init__
    monkeypatch.setattr(bpe.Prefixes, "__init__", lambda self, *a: (tables.append(a[1]), made(self, *a))[1])
    want = [public.encode_ordinary(x) for x in texts]
    known = bpe.Vocabulary.load(PATH, public_tokenizers.PATTERN)
    assert [known.encode(x).tolist() for x in texts] == want and tables == ["éééé".encode() * 32 + b"x"]
    for name, least in (("MEMORY", 4), ("PIECES", 7), ("LONG", 100), ("TOGETHER", 30)):
        monkeypatch.setattr(bpe, name, least)
    small = bpe.Vocabulary(known.ranks, public_tokenizers.PATTERN, keep=50)
    assert [x.tolist() for x in small.encode_all(texts)] == want
    assert [small.decode(x).decode() for x in want] == texts and small.decimal(known.encode(texts[1])).decode() == ",".join(map(str, want[1]))
    with pytest.raises(KeyError):
        small.decode([-1])
