"""Languages of documents and of their passages, by a byte convolutional network.

A text is cut into sentences, each sentence into fixed-length byte windows; the
network, trained on a bounded sample of labelled documents, gives each a
probability for every language. The likeliest sequence of languages, in which a
change has its price, makes the passages.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .network import ByteNet, windows
from .seeds import SEEDS

# Codes and English names of the languages told apart.
LANGUAGES = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german"],
    "fr": ["fra", "fre", "french"],
    "es": ["spa", "spanish", "castilian"],
    "pt": ["por", "portuguese"],
    "nl": ["nld", "dut", "dutch", "flemish"],
    "it": ["ita", "italian"],
    "ru": ["rus", "russian"],
}
CODES = list(LANGUAGES)
#: Bounds of the training sample: documents of each language, and sentences of each document.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES = 250, 16
STEPS = 2500
#: Times each seed sentence counts.
SEED_WEIGHT = 6
#: Log-odds that a change of language between two sentences costs.
CHANGE = 3.0
#: A single sentence's evidence is bounded, so that one odd sentence makes no passage.
MOST_EVIDENCE = 6.0
#: Sentences a passage needs at least.
PASSAGE = 2

_TAG = re.compile(r"<[^<>]{0,200}>")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)")
_WORD = re.compile(r"[^\W\d_]{2,}")
_QUOTED = re.compile(r"\([^()]*\)|\"[^\"]*\"|«[^«»]*»|“[^“”]*”")
_SPACE = re.compile(r"\s+")
_DIGIT = re.compile(r"\d+")


def named_language(label: Column) -> Column:
    """The two-letter code a label names (ISO code or English name, any case, with or without a region), else null."""
    names = {code: code for code in CODES} | {name: code for code, more in LANGUAGES.items() for name in more}
    lookup = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    head = F.regexp_extract(F.lower(label), r"^\s*([a-z]+)(?:[-_ (.@].*)?$", 1)
    return F.try_element_at(lookup, head)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence: a run of at least two words with a full stop at its end.

    Line breaks and tags end a run; what has no full stop (headings, signatures,
    codes, tables) is none, unless it is as long as five words.
    """
    plain = _TAG.sub(lambda m: "\n" + " " * (len(m[0]) - 1), text) if "<" in text else text
    out = []
    at = 0
    for line in plain.split("\n"):
        start = 0
        for stop in _END.finditer(line):
            if len(_WORD.findall(line, start, stop.end())) >= 2:
                out.append((at + start, at + stop.end()))
                start = stop.end()
            elif not line[start : stop.end()].strip(" .!?…"):
                start = stop.end()
        if start < len(line) and len(_WORD.findall(line, start)) >= 5:
            out.append((at + start, at + len(line)))
        at += len(line) + 1
    trimmed = []
    for a, b in out:
        piece = plain[a:b]
        trimmed.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())))
    return trimmed


def prepared(sentence: str) -> bytes:
    """A sentence as the network reads it: composed, lower case, without quoted phrases, numbers as 0, single blanks."""
    s = html.unescape(sentence) if "&" in sentence else sentence
    if "<" in s:
        s = _TAG.sub(" ", s)
    bare = _QUOTED.sub(" ", s)
    if len(_WORD.findall(bare)) >= 2:
        s = bare
    s = _DIGIT.sub("0", unicodedata.normalize("NFC", s.lower()))
    return _SPACE.sub(" ", s).strip().encode("utf-8", "replace")


def _unaccented(data: bytes) -> bytes:
    s = unicodedata.normalize("NFD", data.decode("utf-8", "replace"))
    return "".join(c for c in s if not unicodedata.combining(c)).encode()


def _balanced(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rare languages repeated up to half the rows of the commonest."""
    most = max(np.bincount(y).max() // 2, 1)
    rows = np.concatenate([np.resize(np.flatnonzero(y == c), max(most, int((y == c).sum()))) for c in np.unique(y)])
    return x[rows], y[rows]


def train(labelled: list[tuple[str, str]], *, steps: int = STEPS, seed: int = 5) -> ByteNet:
    """A network from (text, language) pairs, some of them wrong, and the seed sentences.

    The labels are taken as they are for a first fit; sentences that it puts
    elsewhere with confidence are left out of the second.
    """
    rng = np.random.default_rng(seed)
    texts: list[bytes] = []
    labels: list[int] = []
    for text, code in labelled:
        spans = sentences(text)
        if len(spans) > SAMPLE_SENTENCES:
            spans = [spans[i] for i in sorted(rng.choice(len(spans), SAMPLE_SENTENCES, replace=False))]
        for a, b in spans:
            texts.append(prepared(text[a:b]))
            labels.append(CODES.index(code))
    for code, lines in SEEDS.items():
        # The seeds carry a language that the sample lacks, and words beyond its domain for one it has.
        texts += [prepared(line) for line in lines] * SEED_WEIGHT
        labels += [CODES.index(code)] * (len(lines) * SEED_WEIGHT)
    plain = [t for t in texts if t]
    y_text = np.array([c for t, c in zip(texts, labels, strict=True) if t])
    varied, y_varied = list(plain), list(y_text)
    for t, c in zip(plain, y_text, strict=True):
        varied.append(_unaccented(t))
        y_varied.append(c)
    x, owner, used = windows(varied)
    y = np.array(y_varied)[owner]
    keep = used >= 8
    x, y = x[keep], y[keep]
    net = ByteNet(len(CODES), seed)
    net.fit(*_balanced(x, y), max(steps // 3, 1), seed=seed)
    log_p = net.log_probabilities(x)
    wrong = (log_p.argmax(axis=1) != y) & (log_p.max(axis=1) > np.log(0.6))
    x, y = x[~wrong], y[~wrong]
    net.fit(*_balanced(x, y), steps - steps // 3, rate=0.003, seed=seed + 1)
    return net


def training_sample(documents: DataFrame, text_col: str, label_col: str, id_col: str) -> list[tuple[str, str]]:
    """At most SAMPLE_DOCUMENTS documents of each named language, the first in the order of a hash of the id."""
    code = named_language(F.col(label_col).cast("string"))
    # The count reads the labels alone; the hash then narrows the one scan of the texts to about as many as are wanted.
    total = {r[0]: r[1] for r in documents.select(code.alias("code")).filter("code is not null").groupBy("code").count().collect()}
    named = documents.select(code.alias("code"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("h"), F.col(id_col).alias("id"))
    # Long texts add nothing to a sample that takes a few sentences of each.
    named = named.filter("code is not null and length(text) between 40 and 20000")
    out: list[tuple[str, str]] = []
    if not total:
        return out
    pick = F.lit(False)
    for code, n in total.items():
        share = min(1.0, 2.0 * (SAMPLE_DOCUMENTS + 50) / n)
        pick = pick | ((F.col("code") == code) & (F.pmod("h", F.lit(10**15)) < round(share * 10**15)))
    first = Window.partitionBy("code").orderBy(F.pmod("h", F.lit(10**15)), "h", "id")
    rows = named.filter(pick).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLE_DOCUMENTS)
    return [(r["text"], r["code"]) for r in rows.select("code", "r", "text").orderBy("code", "r").collect()]


def best_sequence(evidence: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The likeliest language of each sentence if every change costs ``change`` (Viterbi)."""
    n, k = evidence.shape
    score = evidence[0].copy()
    back = np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(score.argmax())
        moved = score[top] - change
        stay = score >= moved
        back[i] = np.where(stay, np.arange(k), top)
        score = np.where(stay, score, moved) + evidence[i]
    path = np.empty(n, np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


_SEGMENT = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64())])
_SEGMENT_SQL = "array<struct<lang: string, confidence: double, sentences: int, char_start: bigint, char_end: bigint>>"


def classify_texts(net: ByteNet, texts: list[str | None], cache: dict[bytes, np.ndarray] | None = None, cache_size: int = 200_000) -> list[list[dict]]:
    """The passages of each text in order; none where a text has no sentence."""
    cache = {} if cache is None else cache
    spans = [sentences(t) if t else [] for t in texts]
    keys = [[prepared(t[a:b]) for a, b in s] for t, s in zip(texts, spans, strict=True)]
    new = list(dict.fromkeys(k for own in keys for k in own if k not in cache))
    if len(cache) + len(new) > cache_size:
        cache.clear()
        new = list(dict.fromkeys(k for own in keys for k in own))
    if new:
        x, owner, used = windows(new)
        log_p = net.log_probabilities(x)
        summed = np.zeros((len(new), log_p.shape[1]))
        np.add.at(summed, owner, log_p)
        summed -= summed.max(axis=1, keepdims=True)
        summed = np.maximum(summed, -MOST_EVIDENCE)
        summed -= np.log(np.exp(summed).sum(axis=1, keepdims=True))
        cache.update(zip(new, summed, strict=True))
    out = []
    for own, s in zip(keys, spans, strict=True):
        if not own:
            out.append([])
            continue
        evidence = np.array([cache[k] for k in own])
        path = best_sequence(evidence)
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        segments = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            confidence = float(np.exp(evidence[a:b, path[a]]).mean())
            segments.append({"lang": CODES[path[a]], "confidence": round(confidence, 4), "sentences": b - a, "char_start": s[a][0], "char_end": s[b - 1][1]})
        out.append(segments)
    return out


def _worker(shared, schema: pa.Schema):
    def run(batches):
        net, cache = ByteNet.of(shared.value), {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, len(texts), 512):
                found = classify_texts(net, texts.slice(start, 512).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([ids.slice(start, 512), batch.column(2).slice(start, 512), pa.array(found, pa.list_(_SEGMENT))], schema=schema)

    return run


def passages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", net: ByteNet | None = None) -> DataFrame:
    """One row for each document: doc_id, named_lang, and its passages (lang, confidence, sentences, char_start, char_end).

    Null and empty texts and those without a sentence have no passage. Only the
    named columns are read; repeated documents are judged each; without any label
    the network knows the seed sentences alone. An empty table gives an empty result.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    if net is None:
        net = train(training_sample(documents, text_col, label_col, id_col))
    # Bare arrays, some 50 kB whatever the data: an instance would need this package on the workers' path.
    shared = documents.sparkSession.sparkContext.broadcast(net.p)
    inner = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("sentences", T.IntegerType()), T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType), T.StructField("named_lang", T.StringType()), T.StructField("passages", inner)])
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), named_language(F.col(label_col).cast("string")).alias("named_lang"))
    return slim.mapInArrow(_worker(shared, to_arrow_schema(schema)), schema)


def document_languages(judged: DataFrame) -> DataFrame:
    """The language of each document, that of most of its characters: doc_id, named_lang, lang, confidence, label_agrees, n_languages."""
    # Within a row's own passages, by expressions over the array: no shuffle.
    length = lambda p: p["char_end"] - p["char_start"]
    langs = F.array_distinct(F.transform("passages", lambda p: p["lang"]))
    share = lambda lang: F.aggregate(F.filter("passages", lambda p: p["lang"] == lang), F.lit(0).cast("long"), lambda a, p: a + length(p))
    sure = lambda lang: F.aggregate(F.filter("passages", lambda p: p["lang"] == lang), F.lit(0.0), lambda a, p: a + p["confidence"] * length(p))
    ranked = F.array_max(F.transform(langs, lambda lang: F.struct(share(lang).alias("chars"), lang.alias("lang"), sure(lang).alias("sure"))))
    return judged.select("doc_id", "named_lang", ranked.alias("top"), F.size(langs).alias("n_languages")).select(
        "doc_id", "named_lang", F.col("top.lang").alias("lang"), F.round(F.try_divide(F.col("top.sure"), F.col("top.chars")), 4).alias("confidence"), (F.col("top.lang") == F.col("named_lang")).alias("label_agrees"), "n_languages"
    )


def segments(judged: DataFrame) -> DataFrame:
    """Every passage: doc_id, passage_no, lang, confidence, sentences, char_start, char_end."""
    return judged.select("doc_id", F.posexplode("passages").alias("passage_no", "p")).select("doc_id", "passage_no", "p.*")


def unnamed_languages(judged: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Languages of whole texts and of passages of at least ``passage`` sentences that the label does not name: doc_id, lang_found."""
    counts = F.filter("passages", lambda p: (p["sentences"] >= passage) | (F.size("passages") == 1))
    found = judged.select("doc_id", "named_lang", F.explode(F.array_distinct(F.transform(counts, lambda p: p["lang"]))).alias("lang_found"))
    return found.filter(F.col("named_lang").isNull() | (F.col("named_lang") != F.col("lang_found"))).select("doc_id", "lang_found")
