"""Language identification by language-bitmask n-gram filters.

Training takes a bounded sample of labelled documents (SAMPLE a language, of the LANGUAGES languages
with most documents; documents in others are predicted as one of these or `und`), counts in how
many of a language's documents each letter trigram stands, and keeps as a language's set the
trigrams that are frequent in it and not much rarer than in any other language. Trigrams that are
rare in a language are left out before the driver sees any. The sets go into one bit-sliced
Bloom filter: a slot is a word with a bit for each language, insertion ORs a language's bit into k
slots, and a look-up ANDs k slots, which gives the mask of all languages whose set may hold the
trigram. For a text the masks' bits are counted by language; of n look-ups a language with false
positive rate f is expected to get f for each trigram that isn't its own, so the count c is
corrected to (c - f n) / (1 - f). The largest corrected count decides.

Defined cases: a null text, and one without a letter, is `und` with score 0; without any labelled
document all are `und`; a text with letters but no known trigram gets the language with most
training documents and score 0; ties go to the language with more training documents, then by
name. Rows without lang are not learned from. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from reckon.llm.common import blocks, fresh, map_arrow, quoted, remainder

#: Labelled documents used for each language, at most about; drawn by a hash of id and text.
SAMPLE = 2000
#: Languages that are learned at most: those with most labelled documents.
LANGUAGES = 1024
#: A trigram is a language's own if it stands in this share of its sampled documents ...
FREQUENT = 0.002
#: ... and in at least this share of the documents of the language where it is most frequent.
RELATIVE = 0.35
HASHES = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed trigrams of the lower-cased texts (a blank for each run of other characters), the
    index of their text, and for each text whether it has a letter."""
    low = [(t or "").lower() for t in texts]
    raw = "\n\n" + "\n\n".join(low) + "\n\n"
    c = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 2 for t in low), np.int64, len(low))
    owner = np.repeat(np.arange(len(texts)), lengths)
    owner = np.concatenate([owner[:1], owner[:1], owner]) if len(texts) else owner
    letter = _letters()[c]
    keep = letter | np.concatenate([[True], letter[:-1]])  # letters, and the first of other characters
    c, owner, letter = np.where(letter, c, 32)[keep].astype(np.uint64), owner[: len(keep)][keep], letter[keep]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    packed = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    real = letter[1:-1]
    return packed[real], owner[1:-1][real], has


def _slots(packed: np.ndarray, bits: int) -> list[np.ndarray]:
    h = packed * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    a, b = h >> np.uint64(64 - bits), (h >> np.uint64(5)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    return [((a + np.uint64(i) * b) & mask).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filter:
    """table: slots x words of 64 languages; rates: false positives by language."""

    languages: list[str]
    bits: int
    table: np.ndarray
    rates: np.ndarray

    @classmethod
    def of(cls, sets: list[tuple[str, np.ndarray]]) -> "Filter":
        most = max([1, *(len(s) for _, s in sets)])
        bits = max(12, int(np.ceil(np.log2(most * HASHES * 3))))
        table = np.zeros((1 << bits, (len(sets) + 63) // 64 or 1), np.uint64)
        for k, (_, grams) in enumerate(sets):
            for s in _slots(grams, bits):
                table[s, k // 64] |= np.uint64(1 << (k % 64))
        fill = [((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(sets))]
        return cls([name for name, _ in sets], bits, table, np.array(fill) ** HASHES)

    def masks(self, packed: np.ndarray) -> np.ndarray:
        a, *rest = _slots(packed, self.bits)
        out = self.table[a]
        for s in rest:
            out &= self.table[s]
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected counts (texts x languages), look-ups and letters of each text."""
        packed, owner, has = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        out = np.zeros((len(texts), len(self.languages)))
        masks = self.masks(packed)
        for k, rate in enumerate(self.rates):
            hit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            out[:, k] = np.bincount(owner, weights=hit, minlength=len(texts))
            out[:, k] = np.maximum(0, (out[:, k] - rate * n) / (1 - rate)) if rate < 1 else 0
        return out, n, has


def train(docs: DataFrame, sample: int = SAMPLE) -> Filter:
    """A filter from docs (doc_id, text, lang), all of which may be learned from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_lang = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    n_of = {r["lang"]: r["n"] for r in by_lang.collect()}
    if not n_of:
        return Filter.of([])
    share = docs.sparkSession.createDataFrame([(x, min(1.0, sample / n)) for x, n in n_of.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    picked = known.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(share), "lang").where(drawn).select("lang", "text")  # LANGUAGES rows at most

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        out_l, out_g, out_n = [], [], []
        names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        seen: list[list[np.ndarray]] = [[] for _ in names]
        for a, z in blocks(texts):
            packed, owner, _ = trigrams(texts[a:z])
            order = np.lexsort((packed, owner))
            packed, owner = packed[order], owner[order]
            new = np.ones(len(packed), bool)
            new[1:] = (packed[1:] != packed[:-1]) | (owner[1:] != owner[:-1])
            packed, owner = packed[new], owner[new]
            lang = np.fromiter((names[x] for x in langs[a:z]), np.int64, z - a)[owner] if len(owner) else owner
            for k in range(len(names)):
                seen[k].append(packed[lang == k])
        for name, k in names.items():
            grams, n = np.unique(np.concatenate(seen[k]), return_counts=True) if seen[k] else (np.empty(0), np.empty(0))
            out_l += [name] * len(grams)
            out_g.append(grams.astype(np.int64))
            out_n.append(n.astype(np.int64))
        return pa.RecordBatch.from_pydict({"lang": pa.array(out_l, pa.string()), "gram": np.concatenate(out_g), "n": np.concatenate(out_n)})

    took = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    sizes = docs.sparkSession.createDataFrame(list(took.items()), "lang string, took long")
    grams = map_arrow(picked, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # what is rare in a language is in no set of its, and never the most frequent: it stays out of the driver
    frequent = grams.join(F.broadcast(sizes), "lang").select("lang", "gram", (F.col("n") / F.col("took")).alias("rate")).where(F.col("rate") >= FREQUENT)  # LANGUAGES rows at most
    rows = frequent.toPandas()  # of a language at most 1 / FREQUENT times the mean trigrams of its documents
    best = rows.groupby("gram")["rate"].transform("max")
    own = rows[rows["rate"] >= RELATIVE * best].sort_values(["rate", "gram"], ascending=[False, True])
    return Filter.of([(lang, own.loc[own["lang"] == lang, "gram"].to_numpy().astype(np.uint64)) for lang in n_of])


def predict(docs: DataFrame, model: Filter, to: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """All of docs' columns, and under the names of `to` the language, the winner's part of all
    corrected counts, and its part of the text's trigrams; same-named columns are replaced."""
    keep = [f for f in docs.schema.fields if f.name not in to]
    names = [f.name for f in keep]

    def run(b: pa.RecordBatch) -> pa.Table:
        texts, lang, score, cover = b.column("text").to_pylist(), [], [], []
        for a, z in blocks(texts):
            if not model.languages:
                lang, score, cover = lang + ["und"] * (z - a), score + [0.0] * (z - a), cover + [0.0] * (z - a)
                continue
            c, n, has = model.counts(texts[a:z])
            best, total = c.argmax(1), c.sum(1)
            top = c[np.arange(z - a), best]
            score += np.where(has & (total > 0), top / np.maximum(total, 1e-12), 0.0).tolist()
            cover += np.where(has & (n > 0), np.minimum(1, top / np.maximum(n, 1)), 0.0).tolist()
            lang += [model.languages[k] if h else "und" for k, h in zip(best, has)]
        t = pa.Table.from_batches([b])
        for name, x in zip(to, (pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cover, pa.float64()))):
            t = t.append_column(name, x)
        return t

    schema = StructType([*keep, StructField(to[0], StringType()), StructField(to[1], DoubleType()), StructField(to[2], DoubleType())])
    return map_arrow(docs.select(*map(quoted, names)), run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and coverage of every row of docs (doc_id, text, lang).

    Learned from the rows whose crc32(doc_id as text) mod 5 isn't 0."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang"))
    model = train(base.where(remainder("doc_id", 5) != 0))
    out = predict(base.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "coverage")


#: A document is kept if its language's own trigrams make at least this part of all.
LEAST_COVERAGE = 0.3


def keep_identified(docs: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """The rows of docs that are in some learned language, with all their columns; `und`, and text
    of which hardly any trigram is the language's own, are rejected. With no labels to learn from
    only `und` by lack of letters could be told, so nothing else is rejected."""
    base = docs.select("doc_id", "text", "lang")
    model = train(base.where(remainder("doc_id", 5) != 0))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    to = fresh(docs, "lang_pred", "score", "coverage")
    scored = predict(docs, model, tuple(to))
    return scored.where((F.col(to[0]) != "und") & (F.col(to[2]) >= least_coverage)).select(*map(quoted, docs.columns))
