"""Language identification by compression.

Each language has a raw-content Zstandard dictionary: excerpts of its labelled texts. A text is
compressed with each of them, in chunks so that its own repeats don't hide the dictionary, and
the language whose dictionary makes it smallest is chosen. If the second is nearly as small,
the margin is narrow and the text is rejected. Only letters (Unicode category L, and the marks on
them) count: both sides are put in lower case, and what stands between words is one space.

The dictionaries are fitted on a bounded sample: `excerpts` of `excerpt_chars` characters for
each language, of the documents with the smallest seeded hashes. All else covers whole texts.

Defined results: a null text or one without a letter is `und`, with score 0, and rejected; with
nothing to learn from, all are; ties go to the language of more labelled documents, then to
the one that sorts first; repeated rows are rows of their own, but one excerpt at most is learned
from rows alike; texts of any length are compressed whole; an empty table gives an empty result.
Other columns are left alone; those named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import order_key, short_batches

#: What a text is rejected below, of the score (see Model.predict).
MARGIN = 0.01
BETWEEN, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
PREDICTION = "lang_pred string, score double, rejected boolean"


def letters(text: str) -> bytes:
    """The words of a text in UTF-8; nothing if it has no letter."""
    return b"" if LETTER.search(text) is None else BETWEEN.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Model:
    """Dictionaries by language: at most excerpts x excerpt_chars characters for each; and how many documents it was learned for."""

    dictionaries: dict[str, bytes]
    documents: dict[str, int]
    level: int = 3
    chunk: int = 4096

    def packers(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        options = zstandard.ZstdCompressionParameters.from_level(self.level, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        out = []
        for lang in sorted(self.dictionaries):
            content = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=options)
            out.append((lang, zstandard.ZstdCompressor(compression_params=options, dict_data=content)))
        return out

    def predict(self, text: str | None, packers: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the share of the text's compressed bytes that the second
        language needs more than the first, times 4 and 1 at most: a language's dictionary saves about a quarter."""
        data = letters(text or "")
        if not data or not packers:
            return "und", 0.0, True
        parts = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        sizes = sorted((sum(len(p.compress(x)) for x in parts), -self.documents[lang], lang) for lang, p in packers)
        score = min(1.0, 4.0 * (1 - sizes[0][0] / sizes[1][0])) if len(sizes) > 1 else 1.0
        return sizes[0][2], score, score < MARGIN


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that nothing is learned from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, *, excerpts: int = 192, excerpt_chars: int = 1200, seed: int = 5) -> Model:
    """Learn from labelled (doc_id, text, lang). The sample's ids are chosen on narrow rows, then joined to texts."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    told = ["doc_id", "lang", "_key", "_hash"]
    keyed = usable.select("doc_id", "lang", order_key(seed, F.col("doc_id")).alias("_key"), F.xxhash64("text").alias("_hash"), "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_key", "doc_id", "_hash"))
    chosen = keyed.select(*told).withColumn("_n", place).filter(F.col("_n") <= excerpts).select(*told).distinct()
    room = F.greatest(F.length("text") - excerpt_chars, F.lit(0)) + 1
    part = F.substring(F.col("text"), (F.pmod(F.col("_key"), room) + 1).cast("int"), F.lit(excerpt_chars))
    # At most `excerpts` rows for each language are broadcast and come back, rows alike as one.
    texts = keyed.join(F.broadcast(chosen), told).groupBy("lang", "_key", "doc_id", "_hash").agg(F.min(part).alias("part"))
    rows = sorted((r["lang"], r["_key"], r["part"]) for r in texts.collect())
    by_lang: dict[str, list[str]] = {}
    for lang, _, text in rows:
        by_lang.setdefault(lang, []).append(text)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    return Model({lang: b" ".join(map(letters, x[:excerpts])) for lang, x in by_lang.items()}, counts)


def predict(texts: Column, model: Model) -> Column:
    """A struct (lang_pred, score, rejected) for each text."""

    @F.pandas_udf(PREDICTION)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packers = model.packers()
        for batch in batches:
            yield pd.DataFrame([model.predict(x, packers) for x in batch], columns=["lang_pred", "score", "rejected"])

    return of(texts)


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with held_out, lang_pred, score and rejected; learns from those not held out."""
    short_batches(docs.sparkSession)
    docs = docs.drop("held_out", "lang_pred", "score", "rejected")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    told = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("_prediction", predict(F.col("text"), model))
    return told.select(*docs.columns, "held_out", *[F.col(f"_prediction.{x}").alias(x) for x in ("lang_pred", "score", "rejected")])
