"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior per page: the likelihood of the visible text (character trigrams, counted over
all documents of known language), the language that the markup declares, a language code in the address, and the prior of
the host. How far declarations and addresses can be trusted is counted over all pages, by the text's own posteriors. Host
priors are smoothed along the address: host towards domain, domain towards suffix, suffix towards all pages, where a
country suffix adds pseudo-counts for its languages. A page's own vote is taken out of its host's prior.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import slices, staged

CELLS = 1 << 13
OPENS = re.compile(r"<(script|style|template|noscript)\b|<!--", re.I)
CLOSES = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "template", "noscript")} | {None: re.compile("-->")}
TAG = re.compile(r"<[^>]*>")
HEAD_TAG = re.compile(r"<(html|meta)\b[^>]*", re.I)
HTML_LANGUAGE = re.compile(r"""\b(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)
META_NAME = re.compile(r"""content-language["']""", re.I)
META_LANGUAGE = re.compile(r"""content\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)
HOST = re.compile(r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(/[^?#]*)?")
#: Languages of country suffixes. Fixed values.
COUNTRIES = {
    "de": "de", "at": "de", "li": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es",
    "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl",
}


@dataclass(frozen=True)
class LanguageOptions:
    """temper: weight of the text's log likelihood (trigrams overlap, so they are no independent evidence); most_grams:
    length beyond which more text adds no certainty; strength: pseudo-counts of the level above in a prior."""

    temper: float = 0.05
    most_grams: int = 400
    smoothing: float = 0.5
    strength: float = 5.0
    country: float = 3.0


def trigram_cells(data: np.ndarray) -> np.ndarray:
    """Cell of the trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 13)


def _count(languages: list[str]):
    place = {v: i for i, v in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), CELLS), np.int64)
        for batch in slices(batches, "text"):
            texts: dict[int, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(place[lang], []).append(text.lower().encode())
            for k, own in texts.items():
                data = np.frombuffer(b"  ".join([b"", *own, b""]), np.uint8)
                counts[k] += np.bincount(trigram_cells(data), minlength=CELLS)
        lang, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[lang, cell])], names=["lang", "cell", "n"])

    return run


def trigram_model(docs: DataFrame, languages: list[str], smoothing: float = 0.5) -> np.ndarray:
    """Log probability of each cell in each language, from all documents of known language. CELLS numbers per language."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_count(languages), "lang int, cell int, n long")
    counts = np.full((len(languages), CELLS), smoothing)
    for r in rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"], r["cell"]] += r["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def visible_text(page: str) -> str:
    """Text outside of tags, comments and hidden elements. An element that isn't closed hides nothing; what closes it is looked
    for once, so time grows with the page."""
    out, at, unclosed = [], 0, set()
    for m in OPENS.finditer(page):
        name = m.group(1) and m.group(1).lower()
        if m.start() < at or name in unclosed:
            continue
        end = CLOSES[name].search(page, m.end())
        if end is None:
            unclosed.add(name)
            continue
        out.append(page[at : m.start()])
        at = end.end()
    out.append(page[at:])
    shown = " ".join(out)
    last = shown.rfind(">") + 1  # no tag ends behind it
    return html.unescape(TAG.sub(" ", shown[:last]) + shown[last:])


def declared_language(page: str) -> str | None:
    """The code of the first html or meta tag that declares a language; every tag is read once."""
    for m in HEAD_TAG.finditer(page):
        tag = m.group()
        if m.group(1).lower() == "html":
            found = HTML_LANGUAGE.search(tag)
        else:
            name = META_NAME.search(tag)
            found = name and META_LANGUAGE.search(tag, name.end())
        if found:
            return found.group(1).lower()
    return None


#: Second-level names under which countries register domains. Fixed values.
REGISTRIES = {"ac", "co", "com", "edu", "gov", "net", "org"}


def address_parts(url: str | None) -> tuple[str | None, str | None, str | None, list[str]]:
    """(host, domain, suffix, labels and first path segment that may name a language)."""
    m = HOST.match(url or "")
    host = m.group(1).lower().strip(".") if m else ""
    if not host:
        return None, None, None, []
    labels = host.split(".")
    own = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in REGISTRIES else 2
    segments = [s for s in (m.group(2) or "").split("/") if s]
    return host, ".".join(labels[-own:]), labels[-1], [*labels[:-own], *[re.split(r"[-_.]", s)[0].lower() for s in segments[:1]]]


EVIDENCE = "page_id long, host string, domain string, suffix string, declared int, address int, loglik array<double>"


def _read_pages(languages: list[str], model: np.ndarray, o: LanguageOptions):
    """Declared and address language as places in `languages`; len(languages) stands for another one, one more for none."""
    place, n = {v: i for i, v in enumerate(languages)}, len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            urls = [address_parts(u) for u in batch.column("url").to_pylist()]
            declared, logs = [], []
            for page in batch.column("html").to_pylist():
                code = declared_language(page)
                declared.append(place.get(code, n) if code else n + 1)
                data = np.frombuffer(b"  " + " ".join(visible_text(page).lower().split()).encode() + b"  ", np.uint8)
                total = model[:, trigram_cells(data)].sum(axis=1)
                logs.append(total * o.temper * min(1.0, o.most_grams / (len(data) - 2)))
            address = [next((place[x] for x in u[3] if x in place), n + 1) for u in urls]
            text = [pa.array([u[i] for u in urls], pa.string()) for i in range(3)]
            columns = [batch.column("page_id"), *text, pa.array(declared, pa.int32()), pa.array(address, pa.int32()), pa.array(logs, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in EVIDENCE.split(", ")])

    return run


def normal(logs: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, by: list[str], column: str, n: int) -> DataFrame:
    """Sum of the vectors of each group, by partial aggregates."""
    totals = df.groupBy(*by).agg(*[F.sum(F.col(column)[i]).alias(f"_{i}") for i in range(n)])
    return totals.select(*by, F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(n)]).alias("votes"))


def channel(df: DataFrame, column: str, posterior: str, n: int, smoothing: float) -> Column:
    """log P(value of column | language) as an array, from the posteriors of all pages: n + 2 values by n languages."""
    counts = np.full((n + 2, n), smoothing)
    for i in range(n):
        counts[i, i] += 4 * smoothing  # a code means its language unless the pages say otherwise
    for r in _sums(df, [column], posterior, n).collect():
        counts[r[column]] += r["votes"]
    logs = np.log(counts / counts.sum(axis=0))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in logs])
    return F.element_at(table, F.col(column) + 1)


def add(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def identify(spark: SparkSession, pages: DataFrame, docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> DataFrame:
    """Per row of pages: page_id, host, lang, probability, text_lang (by the text alone), declared (code or null).

    A missing or empty page has no text evidence, a missing address only the prior of all pages; without any evidence that
    prior decides. Languages are those of docs; without documents of known language lang is null and the probability 0. Ties
    go to the smaller code. Repeated rows stay, extra columns are ignored, an empty table gives no rows. Texts count whole.
    """
    o = options
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r["lang"] for r in known.collect())  # language codes, not documents
    n = len(languages)
    if not n:
        missing = F.lit(None).cast("string")
        return pages.select(
            F.col("page_id").cast("long").alias("page_id"), missing.alias("host"), missing.alias("lang"), F.lit(0.0).alias("probability"), missing.alias("text_lang"), missing.alias("declared")
        )
    model = spark.sparkContext.broadcast(trigram_model(docs, languages, o.smoothing))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))

    def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_pages(languages, model.value, o)(batches)

    seen = staged(spark, rows.mapInArrow(read_pages, EVIDENCE), "evidence")
    seen = seen.withColumn("by_text", normal(F.col("loglik")))
    clues = add(F.col("loglik"), channel(seen, "declared", "by_text", n, o.smoothing), channel(seen, "address", "by_text", n, o.smoothing))
    voted = staged(spark, seen.withColumn("clues", clues).withColumn("vote", normal(F.col("clues"))), "votes")

    everywhere = _sums(voted, [], "vote", n).first()["votes"]
    share = (np.array(everywhere) + o.smoothing) / (sum(everywhere) + n * o.smoothing)
    overall = F.array(*[F.lit(float(x)) for x in share])
    of_country = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    extra = F.array(*[F.when(of_country[F.col("suffix")] == v, o.country).otherwise(0.0) for v in languages])

    def smoothed(votes: Column, above: Column) -> Column:
        raised = F.zip_with(votes, above, lambda v, p: F.greatest(v, F.lit(0.0)) + o.strength * p)
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))

    placed = voted.filter("host IS NOT NULL")
    suffixes = _sums(placed, ["suffix"], "vote", n).select("suffix", smoothed(add(F.col("votes"), extra), overall).alias("suffix_prior"))
    domains = _sums(placed, ["suffix", "domain"], "vote", n).join(suffixes, "suffix").select("domain", smoothed(F.col("votes"), F.col("suffix_prior")).alias("domain_prior"))
    hosts = _sums(placed, ["domain", "host"], "vote", n).join(domains, "domain").select("host", "votes", "domain_prior")
    fused = voted.join(hosts, "host", "left")
    others = F.zip_with(F.col("votes"), F.col("vote"), lambda s, v: s - v)
    prior = F.when(F.col("votes").isNull(), overall).otherwise(smoothed(others, F.col("domain_prior")))
    posterior = normal(add(F.col("clues"), F.transform(prior, lambda x: F.ln(x))))
    codes = F.array(*[F.lit(v) for v in languages])
    best = lambda c: F.element_at(codes, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    out = fused.withColumn("posterior", posterior)
    return out.select(
        "page_id", "host", best("posterior").alias("lang"), F.array_max("posterior").alias("probability"), best("by_text").alias("text_lang"),
        F.when(F.col("declared") < n, F.element_at(codes, F.col("declared") % n + 1)).alias("declared"),
    )
