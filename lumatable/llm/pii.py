"""Personal details in free text, found and replaced by typed placeholders.

Generators propose spans with high recall (pii_candidates); for each kind, boosted trees score them by format and context, and
calibrated probabilities decide. Where accepted spans overlap, the best one stays. The trees are fitted on invented sentences
put between pieces of sampled texts (pii_seeds): how a sentence was made tells its labels, and no rule over the features does.
Sentence forms and given names that the trees do not see calibrate them. The word counts among the features come from all texts
of the corpus.
"""

from __future__ import annotations

import json
import random
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.llm.boosting import BoostedTrees, Platt
from lumatable.llm.pii_candidates import AT_START, GIVEN, KINDS, KNOWN, LEAST, RATE_TEXTS, Candidate, Lexicon, candidates, plain
from lumatable.llm.pii_seeds import OTHER_GIVEN, frames, made
from lumatable.runtime import materialize, ship, spread, table

#: Documents the made sentences are put into, characters up to which a document is taken for that, and characters around a sentence.
SAMPLE_DOCS, SAMPLE_CHARS, AROUND = 3_000, 50_000, 120
#: Sentences made of each form, one in so many forms and given names that calibrate instead of fitting, and the least probability of a detail:
#: below a half, as a detail that is missed costs more than a word too much.
ROUNDS, HELD_OUT, LEAST_PROBABILITY = 24, 4, 0.3
#: Entries the lexicon may have, and entries a task gathers before it gives them on.
LEXICON_ROWS, GATHERED = 1_000_000, 200_000


@dataclass
class Detector:
    """The fitted trees and calibrations of each kind, with the word counts the features need; a few megabytes at most."""

    lexicon: Lexicon
    trees: dict[str, BoostedTrees]
    calibrations: dict[str, Platt]

    def scores(self, kind: str, found: list[Candidate]) -> np.ndarray:
        """The probability of each candidate of a kind."""
        return self.calibrations[kind].apply(self.trees[kind].margins(_matrix(found)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Keep the detector in the shared file system, for other applications."""
        state = {"lexicon": self.lexicon.__getstate__(), "kinds": {k: [self.trees[k].state(), self.calibrations[k].state()] for k in KINDS}}
        spark.createDataFrame([(json.dumps(state),)], "detector string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Detector:
        state, lexicon = json.loads(spark.read.parquet(path).first().detector), Lexicon()
        lexicon.__setstate__(state["lexicon"])
        return cls(lexicon, {k: BoostedTrees.of(v[0]) for k, v in state["kinds"].items()}, {k: Platt(*v[1]) for k, v in state["kinds"].items()})

    def find(self, texts: Iterable[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of what each text holds, without overlaps, in order; candidates of all texts are scored together."""
        normal = [plain(t) if t else ("", None) for t in texts]
        by_kind: dict[str, list[tuple[int, Candidate]]] = {}
        for i, (text, _) in enumerate(normal):
            for c in candidates(text, self.lexicon) if text else ():
                by_kind.setdefault(c.kind, []).append((i, c))
        kept: list[list[tuple[float, Candidate]]] = [[] for _ in normal]
        for kind, rows in by_kind.items():
            scores = self.scores(kind, [c for _, c in rows])
            for (i, c), s in zip(rows, scores.tolist(), strict=True):
                if s >= LEAST_PROBABILITY:
                    kept[i].append((s, c))
        out = []
        for (text, places), good, raw in zip(normal, kept, texts, strict=True):
            spans = [(c.kind, c.start, c.end) for c in _without_overlaps(good)]
            out.append(spans if places is None else [(k, places[a], places[b - 1] + _width(raw, places, b)) for k, a, b in spans])
        return out


def _width(text: str, places: list[int], b: int) -> int:
    """Characters of `text` that the last character before b stands for, with its combining marks."""
    at, n = places[b - 1], 1
    while at + n < len(text) and unicodedata.combining(text[at + n]):
        n += 1
    return n


_ORDER = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "name": 4}


def _without_overlaps(kept: list[tuple[float, Candidate]]) -> list[Candidate]:
    """The best of overlapping spans: by kind first, as a mail address holds a name and an address a number, then by score, where each further word counts a tenth,
    unless the first one may only begin the sentence."""
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []
    for _, c in sorted(kept, key=lambda x: (_ORDER[x[1].kind], (x[1].start - x[1].end) if x[1].kind == "address" else -(x[0] + 0.1 * x[1].text.count(" ") * _begins_well(x[1])), x[1].start - x[1].end, x[1].start)):
        if all(c.end <= a or c.start >= b for a, b in taken):
            taken.append((c.start, c.end))
            out.append(c)
    return sorted(out, key=lambda c: c.start)


def _begins_well(c: Candidate) -> bool:
    """Whether the first word of a name is a known given name, or does not begin a sentence."""
    return c.kind != "name" or bool(c.features[KNOWN]) or not c.features[AT_START]


def _matrix(found: list[Candidate]) -> np.ndarray:
    return np.array([c.features for c in found], dtype=float)


def lexicon_of(docs: DataFrame) -> Lexicon:
    """The lexicon of all distinct texts of (text); an error where it is too large to be sent to all tasks."""
    spark = docs.sparkSession
    ship(spark)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, texts = Lexicon(), 0

        def rows() -> pd.DataFrame:
            every = [("texts", "", texts), *((k, w, n) for k in LEAST for w, n in getattr(held, k).items())]
            return pd.DataFrame(every, columns=["kind", "word", "n"])

        for b in batches:
            for t in b.text:
                held.add(plain(t)[0])
                texts += 1
                if sum(len(getattr(held, k)) for k in LEAST) >= GATHERED:
                    yield rows()
                    held, texts = Lexicon(), 0
        yield rows()

    texts = spread(docs.where("text is not null").select("text")).distinct()
    counts = materialize(texts.mapInPandas(count, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")), "lexicon")
    n_texts = sum(r.n for r in counts.where("kind = 'texts'").collect())
    rate = F.col("n") * min(1.0, RATE_TEXTS / max(1, n_texts))
    kept = counts.where(" or ".join(f"kind = '{k}'" for k in LEAST)).where(rate >= F.element_at(F.create_map(*(F.lit(x) for kv in LEAST.items() for x in kv)), F.col("kind")))
    if kept.limit(LEXICON_ROWS + 1).count() > LEXICON_ROWS:
        raise ValueError(f"the corpus has a lexicon of more than {LEXICON_ROWS} entries")
    out = Lexicon()
    for r in kept.collect():  # at most LEXICON_ROWS
        getattr(out, r.kind)[r.word] = r.n
    return out.rated(n_texts)


def labelled_sentences(texts: list[str], lexicon: Lexicon, every: list[tuple[str, bool]], given: tuple[str, ...], rounds: int, seed: int) -> dict[str, list[Candidate]]:
    """Candidates of each kind in made sentences of the given forms, each between two pieces of a sampled text, with their labels: 1 for
    exactly a detail the sentence was made with, 0 for any other span in it."""
    rng, out = random.Random(seed), {k: [] for k in KINDS}
    places = places_of(texts)
    for turn in range(rounds):
        for frame, good in every:
            one = made(rng, frame, good, given, places)
            around = rng.choice(texts) if texts and turn else ""
            cut = rng.randrange(len(around) + 1)
            left, right = _whole_words(around[max(0, cut - AROUND) : cut], around[cut : cut + AROUND])
            text, start = left + one.text + right, len(left)
            wanted = {(k, start + a, start + b) for k, a, b in one.spans}
            for c in candidates(text, lexicon):
                if c.start >= start and c.end <= start + len(one.text):
                    c.label = int((c.kind, c.start, c.end) in wanted)
                    out[c.kind].append(c)
    return out


_PLACE = regex.compile(r"\b(?:in|at|near|over|to|from|bei|nach|über|von|zu|à|en|de|vers|desde|hacia) (\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?)")
#: Sampled texts in which a place must be named.
PLACE_TEXTS = 3


def places_of(texts: list[str]) -> tuple[str, ...]:
    """What several sampled texts name after a word of place, without what begins with a given name: decoys whose words the corpus knows."""
    count = Counter(p for t in texts for p in set(_PLACE.findall(t)))
    return tuple(sorted(p for p, n in count.items() if n >= PLACE_TEXTS and p.split()[0].lower() not in GIVEN))


def _whole_words(left: str, right: str) -> tuple[str, str]:
    """Pieces that end before and begin after a sentence."""
    left, right = left.rpartition(" ")[0], right.partition(" ")[2]
    return (left.rstrip(" ,;:") + ". " if left.strip() else ""), (" " + right if right.strip() else "")


def fit(texts: list[str], lexicon: Lexicon | None = None) -> Detector:
    """A detector from made sentences in sample texts; the same texts give the same detector. Without a lexicon of the corpus, the sample
    is counted as the whole one."""
    normal = [plain(t)[0] for t in texts]
    if lexicon is None:
        lexicon = Lexicon()
        for t in normal:
            lexicon.add(t)
        lexicon.rated(len(normal))
    names = sorted({g.title() for g in GIVEN})
    draw = lambda held: tuple(n for k, n in enumerate(names) if (k % HELD_OUT == 0) == held) + tuple(n for k, n in enumerate(OTHER_GIVEN) if (k % HELD_OUT == 0) == held) * 3
    every = frames()
    seen = labelled_sentences(normal, lexicon, [f for k, f in enumerate(every) if k % HELD_OUT], draw(False), ROUNDS, 1)
    held = labelled_sentences(normal, lexicon, [f for k, f in enumerate(every) if k % HELD_OUT == 0], draw(True), ROUNDS, 2)
    trees, calibrations = {}, {}
    for kind in KINDS:
        label = lambda rows: np.array([c.label for c in rows], dtype=float)
        judge = BoostedTrees().fit(_matrix(seen[kind]), label(seen[kind]))
        calibrations[kind] = Platt.fit(judge.margins(_matrix(held[kind])), label(held[kind]))
        both = seen[kind] + held[kind]  # once calibrated, the trees may see all
        trees[kind] = BoostedTrees().fit(_matrix(both), label(both))
    return Detector(lexicon, trees, calibrations)


def fit_on(docs: DataFrame) -> Detector:
    """A detector with the lexicon of all texts of (doc_id, text), fitted on a bounded sample chosen by hash and so the same in each run."""
    sample = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("text").orderBy(F.xxhash64("text")).limit(SAMPLE_DOCS)
    return fit(sorted({r.text for r in sample.collect()}), lexicon_of(docs))


def detect(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, text, spans, redacted) of documents (doc_id, text): spans are (kind, start, end, found_text) in characters of the
    text as written, redacted is the text with [NAME], [EMAIL], [PHONE], [ID_NUMBER] or [ADDRESS] in their places. Null stays null;
    an empty text has no spans."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(detector or fit_on(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = sent.value.find
        for b in batches:
            spans, texts = [], []
            for text, got in zip(b.text, find(b.text.tolist()), strict=True):
                out, last = [], 0
                for kind, a, z in got:
                    out += [text[last:a], f"[{kind.upper()}]"]
                    last = z
                spans.append([{"kind": k, "start": a, "end": z, "found_text": text[a:z]} for k, a, z in got])
                texts.append(None if text is None else "".join([*out, text[last:]]))
            yield pd.DataFrame({"doc_id": b.doc_id, "text": b.text, "spans": spans, "redacted": texts})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, text string, spans array<struct<kind:string,start:int,end:int,found_text:string>>, redacted string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p10_found: doc_id, kind and found_text of each distinct value in each text."""
    spans = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", "s.kind", "s.found_text").distinct()


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p10_redacted: each text with typed placeholders instead of personal details."""
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "redacted")
