"""Problem 10: languages of documents and of their segments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize, spread

LANGS = ["en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru"]
#: Usual spellings of each language, beside the two letters: three letters, English name, own name.
SPELLINGS = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german", "deutsch"],
    "fr": ["fra", "fre", "french", "français"],
    "es": ["spa", "spanish", "español", "castilian"],
    "pt": ["por", "portuguese", "português"],
    "it": ["ita", "italian", "italiano"],
    "nl": ["nld", "dut", "dutch", "nederlands", "flemish"],
    "pl": ["pol", "polish", "polski"],
    "ru": ["rus", "russian", "русский"],
}
#: Labelled documents a language that the classifier is fitted on (the least hashes of their ids): the bound of the sample.
SAMPLE = 400
#: Buckets of hashed character n-grams, their orders, and the least posterior by which a sentence counts.
BUCKETS, ORDERS, LEAST = 1 << 15, (2, 3, 4), 0.9
SEGMENT = "struct<start:int,end:int,lang:string,confidence:double,sentences:int>"
#: Lengths in characters up to which texts share a temperature, and the share of the sample's documents that temperatures are fitted on.
LENGTHS, HELD_OUT = (5, 10, 20, 40, 80), 5

FENCE = re.compile(r"^[ \t]*(```|~~~)")
SKIP = re.compile(r"^\s*(#{1,6}\s|\[?\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|\[?(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b[\]: ]|at \S+\(|\$ |\|)")
MARK = re.compile(r"^\s*(?:(?:>\s*)+|[-*+]\s+|\d+[.)]\s+)*")
NOISE = re.compile(r"`[^`\n]*`|\b[a-z]+[A-Z]\w*\b|(?<![^\s`])[^\s`]*[_/\\(){}<>=@#0-9][^\s`]*?(?=[.!?…,;:\"'»”]*(?:\s|$))")
#: What any such noise holds.
NOISY = re.compile(r"[`_/\\(){}<>=@#0-9]|[a-z][A-Z]")
STOP = re.compile(r"[.!?…]+[\"'»”)\]]*")
WORD = re.compile(r"[^\W\d_]{2,}")
LETTERS = re.compile(r"[\W\d_]+")


def label_map() -> dict[str, str]:
    return {s: k for k, v in SPELLINGS.items() for s in [k, *v]}


def normal_label(col):
    """The language a label names, or null: capitals, region, three letters, names and white space are usual spellings."""
    bare = F.regexp_extract(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), r"^([\p{L}]+)(?:[-_][\p{L}\d]+)*$", 1)
    pairs = [F.lit(x) for kv in label_map().items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), bare)


def lower(text: str) -> str:
    """Lower case of the same length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def sentences(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, words only, whether it is closed) of the sentences of a text's prose: outside code fences, without headings, log lines,
    tables and in-line code; a line break inside a paragraph doesn't end a sentence, a list item, quote or blank line does. What stands behind the last
    closed sentence of a paragraph is one that isn't closed. A text without any such prose is one sentence that isn't closed, if it has letters."""
    blocks: list[list[tuple[int, str]]] = [[]]
    at, fenced = 0, False
    for line in text.split("\n"):
        plain = line[:1].isalpha()  # neither fence nor mark, and seldom a line to skip
        if not plain and FENCE.match(line):
            fenced = not fenced
            blocks.append([])
        elif fenced or (not plain or line[0] in "TDIWEFa") and SKIP.match(line) or not plain and not line.strip():
            blocks.append([])
        else:
            mark = 0 if plain else MARK.match(line).end()
            if mark and line[:mark].strip():
                blocks.append([])
            blocks[-1].append((at, " " * mark + line[mark:] if mark else line))
        at += len(line) + 1
    out = []
    for block in blocks:
        if not block:
            continue
        start = block[0][0]
        joined = " ".join(x for _, x in block)
        if NOISY.search(joined):
            joined = NOISE.sub(blank, joined)
        at_word = 0
        for m in STOP.finditer(joined):
            s = joined[at_word : m.end()]
            first = WORD.search(s)
            if first and WORD.search(s, first.end()):
                lead = len(s) - len(s.lstrip())
                out.append((start + at_word + lead, start + m.end(), lower(s.strip()), True))
            at_word = m.end()
        s = joined[at_word:]
        if WORD.search(s):
            lead = len(s) - len(s.lstrip())
            out.append((start + at_word + lead, start + at_word + len(s.rstrip()), lower(s.strip()), False))
    if not out:
        words = LETTERS.sub(blank, text)
        if words.strip():
            at = len(words) - len(words.lstrip())
            out.append((at, len(words.rstrip()), lower(words.strip()), False))
    return out


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, (buckets of all n-grams, index of their text) of many texts at once."""
    joined = " " + "  ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint32)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)) + 2
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    found = []
    for n in ORDERS:
        if len(points) < n:
            continue
        h = np.zeros(len(points) - n + 1, dtype=np.uint32)
        for k in range(n):
            h = (h + points[k : len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        same = owner[: len(h)] == owner[n - 1 :]
        found.append((((h >> np.uint32(7)) % np.uint32(BUCKETS))[same], owner[: len(h)][same]))
    return found


def scores(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """Log-probability of each text under each language: a gather from the matrix, summed by text."""
    out = np.zeros((len(texts), logp.shape[1]))
    for a in range(0, len(texts), 512):
        for h, o in grams(texts[a : a + 512]):
            if len(o):  # the grams of a text stand together
                starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                out[a + o[starts]] += np.add.reduceat(logp[h], starts, axis=0)
    return out


def length_class(texts: list[str]) -> np.ndarray:
    return np.searchsorted(LENGTHS, [len(t) for t in texts])


def posterior(s: np.ndarray, temperature: float | np.ndarray = 1.0) -> np.ndarray:
    """Probabilities from log-probabilities divided by a temperature, one for all or one a row."""
    e = np.exp((s - s.max(axis=1, keepdims=True)) / (temperature[:, None] if isinstance(temperature, np.ndarray) else temperature))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Log-probability matrix (BUCKETS x languages) and a temperature for each class of length."""

    logp: np.ndarray
    temperatures: np.ndarray

    def judge(self, texts: list[str]) -> np.ndarray:
        return posterior(scores(texts, self.logp), self.temperatures[length_class(texts)])


def held_out_rows(logp: np.ndarray):
    """A mapInPandas function: scores of sentences, and of runs of one to six words from them, of documents that the model finds to be in one language, the label's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, label in zip(pdf["text"], pdf["label"]):
                whole = [s for _, _, s, closed in sentences(text or "") if closed]
                own = LANGS.index(label)
                if not whole or (scores(whole, logp).argmax(axis=1) != own).any():
                    continue
                rng = np.random.default_rng(len(text))
                parts = []
                for s in whole:
                    w = s.split()
                    n = int(rng.integers(1, 7))
                    at = int(rng.integers(0, max(1, len(w) - n + 1)))
                    parts.append(" ".join(w[at : at + n]))
                texts = [t for t in whole + parts if WORD.search(t)]
                rows += [(own, int(c), *map(float, x)) for c, x in zip(length_class(texts), scores(texts, logp))]
            yield pd.DataFrame(rows, columns=["own", "length", *LANGS])

    return run


def fit_temperatures(rows: pd.DataFrame) -> np.ndarray:
    """For each class of length, the temperature at which the mean confidence equals the share that is right on held-out texts (one more counted wrong
    than were); a class without texts has that of the next longer one."""
    out = np.full(len(LENGTHS) + 1, np.nan)
    for c, part in rows.groupby("length"):
        s = part[LANGS].to_numpy()
        right = (s.argmax(axis=1) == part["own"].to_numpy()).sum() / (len(s) + 1)
        low, high = 0.05, 500.0
        for _ in range(40):
            mid = (low * high) ** 0.5
            low, high = (mid, high) if posterior(s, mid).max(axis=1).mean() > right else (low, mid)
        out[int(c)] = mid
    known = np.flatnonzero(~np.isnan(out))
    return out[known[np.minimum(np.searchsorted(known, np.arange(len(out))), len(known) - 1)]] if len(known) else np.ones(len(out))


def count_rows(logp: np.ndarray | None):
    """A mapInPandas function: n-gram counts by language; with a model, only of sentences that it finds to be in the language of
    the label, so wrong labels and foreign segments drop out of the second fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(LANGS), BUCKETS), dtype=np.int64)
        for pdf in batches:
            texts, own = [], []
            for t, l in zip(pdf["text"], pdf["label"]):
                for _, _, s, closed in sentences(t or ""):
                    if closed:
                        texts.append(s)
                        own.append(LANGS.index(l))
            if not texts:
                continue
            own = np.array(own)
            if logp is not None:
                keep = scores(texts, logp).argmax(axis=1) == own
                texts, own = [t for t, k in zip(texts, keep) if k], own[keep]
                if not texts:
                    continue
            for h, o in grams(texts):
                np.add.at(total, (own[o], h), 1)
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[lang, bucket]})

    return run


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """The classifier, fitted on at most ``per_language`` labelled documents of each language, and its temperatures, for which one in
    HELD_OUT of these is kept back while a first matrix is fitted; the last one is fitted on all of them.

    The sample is taken by hash of the id, with a rank that Spark prunes to ``per_language`` rows a task before the shuffle. Counts
    are summed on the executors; at most BUCKETS x 9 of them reach the driver."""
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").select("doc_id", normal_label(F.col("lang")).alias("label"), F.xxhash64("doc_id").alias("h")).where("label is not null")
    top = ids.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).where(F.col("k") <= per_language)
    held = F.pmod("h", F.lit(HELD_OUT)) == 0
    sample = docs.select("doc_id", "text").join(F.broadcast(top.select("doc_id", "label", held.alias("held")).distinct()), "doc_id").select("text", "label", "held")  # per_language rows a language
    sample = materialize(sample, "lang-sample").repartition(spark.sparkContext.defaultParallelism)
    logp = temperatures = None
    for step in range(3):  # a first fit; one without what that finds mislabelled; the same with the documents kept back
        if step == 2:
            found = sample.where("held").select("text", "label").mapInPandas(held_out_rows(logp), ", ".join(["own int", "length int", *[f"{x} double" for x in LANGS]]))
            temperatures = fit_temperatures(found.toPandas())
        rows = (sample if step == 2 else sample.where("not held")).select("text", "label").mapInPandas(count_rows(logp), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((BUCKETS, len(LANGS)))
        counts[rows["bucket"], rows["lang"]] = rows["n"]
        smooth = counts + 0.1
        logp = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        logp[:, counts.sum(axis=0) == 0] = -50.0  # a language without a labelled text is never found
    return Model(np.ascontiguousarray(logp), temperatures)


def segments(found: list[tuple[int, int, str, bool]], post: np.ndarray) -> list[dict]:
    """Runs of sentences in one language, in order; a sentence below LEAST takes the language of the run before it. The confidence of a run is the mean over
    its sentences in its language, weighed by their length; only closed sentences are counted."""
    out: list[dict] = []
    for (a, b, _, closed), k, p in zip(found, post.argmax(axis=1).tolist(), post.max(axis=1).tolist()):
        sure = p >= LEAST
        if out and (not sure or LANGS[k] == out[-1]["lang"]):
            s = out[-1]
            s["end"] = b
            if LANGS[k] == s["lang"]:
                s["confidence"] += p * (b - a)
                s["weight"] += b - a
                s["sentences"] += closed
        else:
            out.append({"start": a, "end": b, "lang": LANGS[k], "confidence": p * (b - a), "weight": b - a, "sentences": int(closed)})
    for s in out:
        s["confidence"] = round(s["confidence"] / max(1, s.pop("weight")), 4)
    return out


def label_rows(model):
    """A mapInPandas function: the segments of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [sentences(t) if t else [] for t in pdf["text"]]
            flat = [s for p in parts for _, _, s, _ in p]
            post = model.value.judge(flat) if flat else np.zeros((0, len(LANGS)))
            at, segs = 0, []
            for p in parts:
                segs.append(segments(p, post[at : at + len(p)]))
                at += len(p)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "segments": segs})

    return run


def label_documents(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(doc_id, label, segments, languages, main_lang, confidence), one row for each input row.

    ``label`` is the language that the document's label names, or null. ``segments`` are its runs of sentences in one language with
    character offsets and confidence. ``languages`` are those with two full sentences or more, ``main_lang`` the one of them
    with the most sentences (on a tie the first in alphabetical order); where there is none, that of the longest segment, so every text with a letter has one.
    Confidence is the share that is right, as measured on held-out texts of like length, times the share of the document's segments, by
    length, that are in the main language. Both are null for null texts and those without letters. Copies are labelled each for itself; an empty table gives no rows and is not fitted on, and rows without an id
    are left out.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, per_language))  # BUCKETS x 9 floats: 1.2 MB
    rows = spread(docs.where("doc_id is not null").select("doc_id", "text", normal_label(F.col("lang")).alias("label")))
    out = rows.mapInPandas(label_rows(model), f"doc_id long, label string, segments array<{SEGMENT}>")
    names = F.array_distinct(F.transform("segments", lambda s: s.lang))
    tally = F.transform(
        names,
        lambda l: F.struct(
            F.aggregate(F.filter("segments", lambda s: s.lang == l), F.lit(0), lambda a, s: a + s.sentences).alias("n"),
            l.alias("lang"),
            F.aggregate(F.filter("segments", lambda s: s.lang == l), F.lit(0), lambda a, s: a + s.end - s.start).alias("chars"),
            F.aggregate(F.filter("segments", lambda s: s.lang == l), F.lit(0.0), lambda a, s: a + s.confidence * (s.end - s.start)).alias("sure"),
        ),
    )
    # most full sentences where there are two, else most text; then the alphabet
    rank = lambda x: F.struct(F.when(x.n >= 2, -x.n).otherwise(0).alias("a"), F.when(x.n >= 2, 0).otherwise(-x.chars).alias("b"), x.lang.alias("c"), x.sure.alias("sure"))
    out = out.withColumn("tally", tally).withColumn("best", F.get(F.sort_array(F.transform("tally", rank)), F.lit(0)))
    chars = F.aggregate("tally", F.lit(0), lambda a, x: a + x.chars)
    full = F.filter("tally", lambda x: x.n >= 2)
    return out.select(
        "doc_id", "label", "segments", F.transform(full, lambda x: x.lang).alias("languages"), F.col("best.c").alias("main_lang"), F.round(F.try_divide(F.col("best.sure"), chars), 4).alias("confidence")
    )


def mislabelled(labelled: DataFrame) -> DataFrame:
    """(doc_id, lang): every language of each document whose label is missing, unknown or wrong, or which holds several."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("main_lang")) | (F.size("languages") > 1)
    return labelled.where((F.size("languages") >= 1) & wrong).select("doc_id", F.explode("languages").alias("lang"))
