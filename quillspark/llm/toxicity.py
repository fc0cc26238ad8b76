"""A convolutional text classifier of toxicity, trained in numpy.

A word's embedding is the sum of a hashed row for the word and those of its character n-grams over the root of their number, so that
inflected and unseen forms of a known stem score too. Filters of widths 1, 2 and 3 slide over the words, each keeps its
largest response in the document (max pooling), and a logistic layer weighs them. Only a bounded sample is fitted. Thresholds
are calibrated by language on all labelled rows that are not held out, the language being guessed from the words of the text
alone; a score of CUT means the threshold of the text's language.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_array, gather, release, slices, split_words, texts_of, with_text, written

WIDTHS = (1, 2, 3)
#: Bytes of text scored at once: a distinct word has a row of filter responses.
SMALL_SLICE = 4 << 20
CUT = 0.3
#: Steps of a histogram of logits within one unit of their inverse hyperbolic sine, which bounds the bins and clips nothing.
STEPS = 128
#: What a fitted row counts for where a cut is placed, against a row that was kept from fitting: it scores too well.
FITTED = 0.05
#: A language's cut is drawn to the general one as if so many rows of each label spoke for that.
POOL = 10.0
#: Frequent words by which a language is guessed.
FREQUENT = {
    "en": "the and of to in is that it was for on are with as at be this have from or had by not but what all were when we there can an your which their if will each how them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little very after words called just where most know".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux mais comme nous vous sa ses cette elle été fait leur même".split(),
    "es": "de la que el en los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split(),
}
LANGUAGES = (*FREQUENT, "other")
_EDGES = ".,;:!?\"'()[]{}<>*_~#…«»“”‘’"


@dataclass
class Settings:
    """positives, negatives and max_chars bound the sample that is fitted: so many rows of a label at most, of so many characters. enough: training
    ends when a row's mean loss is below that."""

    buckets: int = 1 << 15
    width: int = 16
    filters: int = 8
    examples: int = 28_000
    batch: int = 32
    rate: float = 0.08
    seed: int = 1
    positives: int = 1500
    negatives: int = 2500
    max_chars: int = 1 << 16
    enough: float = 0.02


@dataclass
class Words:
    """Distinct words: hashed row of each, and hashed rows of their n-grams with offsets."""

    row: np.ndarray
    grams: np.ndarray
    at: np.ndarray
    language: np.ndarray


def _grams(data: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of the n-grams of each word, word by word, and how many each has."""
    raw = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, data), np.int64, len(data))
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(data), dtype=np.int32), size)
    rows, owners = [], []
    for n in (3, 4, 5, 6):
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, 2166136261 + n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ raw[j : len(raw) - n + 1 + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        ok = np.arange(len(h)) + n <= end[: len(h)]
        rows.append((h[ok] % np.uint32(buckets)).astype(np.int32))
        owners.append(owner[: len(h)][ok])
    grams = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    owned = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int32)
    return grams[np.argsort(owned, kind="stable")], np.bincount(owned, minlength=len(data))


def words_of(words: list[str], buckets: int, block: int = 1 << 15) -> Words:
    plain = [w.lower().strip(_EDGES) or w for w in words]
    row = np.fromiter((xxhash.xxh3_64_intdigest(f"<{w}>".encode()) for w in plain), np.uint64, len(plain)) % np.uint64(buckets)
    found = [_grams([f"<{w}>".encode() for w in plain[a : a + block]], buckets) for a in range(0, len(plain), block)]
    grams = np.concatenate([g for g, _ in found]) if found else np.zeros(0, dtype=np.int32)
    at = np.concatenate([[0], *(n for _, n in found)]).cumsum()
    code = {w: k for k, name in enumerate(FREQUENT) for w in FREQUENT[name]}
    language = np.fromiter((code.get(w, -1) for w in plain), np.int8, len(plain))
    return Words(row.astype(np.int64), grams, at, language)


def guess_languages(codes: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Language of each text by its frequent words; the last of LANGUAGES if it has none."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    said = words.language[codes] if len(codes) else np.zeros(0, dtype=np.int8)
    hit = said >= 0
    votes = np.bincount(doc[hit] * len(FREQUENT) + said[hit], minlength=n * len(FREQUENT)).reshape(n, len(FREQUENT))
    return np.where(votes.any(axis=1), votes.argmax(axis=1), len(FREQUENT))


@dataclass
class Model:
    settings: Settings
    word: np.ndarray = field(init=False)
    gram: np.ndarray = field(init=False)
    conv: np.ndarray = field(init=False)
    bias: np.ndarray = field(init=False)
    out: np.ndarray = field(init=False)
    base: float = -1.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    #: place of the first filter response of each width and offset: (width, offset) in order
    taps: tuple = tuple((w, j) for w in WIDTHS for j in range(w))

    def __post_init__(self) -> None:
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        self.word = rng.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
        self.gram = rng.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
        self.conv = rng.normal(0, 0.3, (s.width, len(self.taps) * s.filters)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * s.filters, dtype=np.float32)
        self.out = np.abs(rng.normal(0, 0.3, len(WIDTHS) * s.filters)).astype(np.float32)

    def embed(self, words: Words, which: np.ndarray) -> np.ndarray:
        out = self.word[words.row[which]] * np.float32(0.3)
        size = words.at[which + 1] - words.at[which]
        some = np.flatnonzero(size)
        if len(some):
            rows = self.gram[words.grams[gather(words.at[which], size)]]
            cuts = np.cumsum(size[some]) - size[some]
            out[some] += np.add.reduceat(rows, cuts, axis=0) / np.sqrt(size[some, None])
        return out

    def respond(self, codes: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses at every place of texts that end in two blanks, and the offsets with these; table: by code."""
        n, f, pad = np.diff(offsets), self.settings.filters, max(WIDTHS) - 1
        padded = np.full(len(codes) + pad * len(n) + pad, len(table) - 1, dtype=np.int64)
        padded[np.arange(len(codes)) + np.repeat(np.arange(len(n)) * pad, n)] = codes
        size = len(padded) - pad
        out = np.empty((size, len(WIDTHS) * f), dtype=np.float32)
        for k, w in enumerate(WIDTHS):
            at = self.taps.index((w, 0)) * f
            part = table[padded[:size], at : at + f]
            for j in range(1, w):
                part += table[padded[j : size + j], at + j * f : at + (j + 1) * f]
            out[:, k * f : (k + 1) * f] = part
        at = offsets + np.arange(len(offsets)) * pad
        for back in range(1, pad + 1):  # what begins at a blank is blank to its end, whatever text comes next
            out[at[1:] - back] = 0
        return out, at

    def logits(self, codes: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
        n = len(offsets) - 1
        table = np.zeros((len(words.row) + 1, self.conv.shape[1]), dtype=np.float32)
        for a in range(0, len(words.row), 50_000):
            which = np.arange(a, min(a + 50_000, len(words.row)))
            table[which] = self.embed(words, which) @ self.conv
        pooled = np.zeros((n, len(self.out)), dtype=np.float32)
        i = 0
        while i < n:  # about 200 thousand words at a time
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 200_000, side="right")) - 1)
            told, at = self.respond(codes[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)
            pooled[i:j] = np.maximum.reduceat(told, at[:-1], axis=0)
            i = j
        return np.maximum(pooled + self.bias, 0) @ self.out + self.base


def train(texts: list[str], labels: np.ndarray, settings: Settings | None = None) -> Model:
    """Fit on the rows; the thresholds are left to calibrate."""
    s = settings or Settings()
    model = Model(s)
    codes, offsets, distinct = split_words(pa.array(texts, pa.large_string()))
    if not len(labels) or labels.min() == labels.max():  # nothing to learn: one class or none
        model.base = 4.0 if len(labels) and labels[0] else -4.0
        model.out[:] = 0
        return model
    words = words_of(distinct, s.buckets)
    rng = np.random.default_rng(s.seed)
    fit = rng.permutation(len(labels))
    names = ("word", "gram", "conv", "bias", "out")
    sums = {k: np.full_like(getattr(model, k), 1e-3) for k in names}
    base_sum, f = 1e-3, s.filters
    tap_at = {t: k for k, t in enumerate(model.taps)}
    epochs = min(40, max(4, -(-s.examples // len(fit))))

    def step(name: str, rows, grad: np.ndarray) -> None:
        value, seen = getattr(model, name), sums[name]
        seen[rows] += grad * grad
        value[rows] -= s.rate * grad / np.sqrt(seen[rows])

    def summed(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows, one that comes up several times with the sum of its gradients."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        return rows[first], np.add.reduceat(grads[order], first, axis=0)

    for _ in range(epochs):
        rng.shuffle(fit)
        loss = 0.0
        for k in range(0, len(fit), s.batch):
            docs = fit[k : k + s.batch]
            mine = np.concatenate([codes[offsets[d] : offsets[d + 1]] for d in docs])
            size = np.array([offsets[d + 1] - offsets[d] for d in docs])
            which, inverse = np.unique(mine, return_inverse=True)
            emb = model.embed(words, which)
            table = np.concatenate([emb @ model.conv, np.zeros((1, model.conv.shape[1]), np.float32)])
            told, at = model.respond(inverse, np.concatenate([[0], np.cumsum(size)]), table)
            best = np.stack([a + told[a:b].argmax(axis=0) for a, b in zip(at[:-1], at[1:])])
            pooled = np.take_along_axis(told, best, axis=0) + model.bias
            hidden = np.maximum(pooled, 0)
            logit = hidden @ model.out + model.base
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[docs]).astype(np.float32) / len(docs)
            loss += float(np.logaddexp(0, np.where(labels[docs] == 1, -logit, logit)).sum())
            back = err[:, None] * model.out * (pooled > 0)
            padded = np.full(len(told) + max(WIDTHS), len(which))
            padded[np.arange(len(inverse)) + np.repeat(np.arange(len(size)) * (max(WIDTHS) - 1), size)] = inverse
            conv_grad, hits, grads = np.zeros_like(model.conv), [], []
            ext = np.concatenate([emb, np.zeros((1, s.width), np.float32)])
            for i, w in enumerate(WIDTHS):
                g, b = back[:, i * f : (i + 1) * f], best[:, i * f : (i + 1) * f]
                for j in range(w):
                    at_ = tap_at[(w, j)] * f
                    hit = np.where(padded[b] < len(which), padded[b + j], len(which))
                    conv_grad[:, at_ : at_ + f] += np.einsum("df,dfk->kf", g, ext[hit])
                    some = (hit < len(which)) & (g != 0)
                    hits.append(hit[some])
                    grads.append(g[some][:, None] * model.conv[:, at_ : at_ + f].T[np.nonzero(some)[1]])
            step("conv", slice(None), conv_grad)
            step("out", slice(None), hidden.T @ err)
            step("bias", slice(None), back.sum(axis=0))
            base_sum += float(err.sum()) ** 2
            model.base -= s.rate * float(err.sum()) / base_sum**0.5
            hit, grad = np.concatenate(hits), np.concatenate(grads)
            if len(hit):
                hit, grad = summed(hit, grad)
                step("word", *summed(words.row[which[hit]], grad * np.float32(0.3)))
                many = words.at[which[hit] + 1] - words.at[which[hit]]
                step("gram", *summed(words.grams[gather(words.at[which[hit]], many)], np.repeat(grad / np.sqrt(np.maximum(many, 1))[:, None], many, axis=0)))
        if loss < s.enough * len(fit):  # nothing is left to learn from these rows
            break
    return model


def _threshold(seen: np.ndarray, whole: np.ndarray, cuts: np.ndarray) -> float:
    """The middle of the cuts whose F1 is within 0.02 of the best, so that one odd row of a small set does not move it.

    seen: clean and toxic rows by bin, which count for the rows of their label in whole; cuts: the lower end of each bin.
    """
    clean, toxic = (seen * (whole / seen.sum(axis=1))[:, None])[:, ::-1]
    hits = np.cumsum(toxic)
    f1 = 2 * hits / np.maximum(hits + np.cumsum(clean) + hits[-1], 1e-9)
    sound = np.cumsum((clean + toxic) * (f1 >= f1.max() - 0.02))
    return float(cuts[::-1][np.searchsorted(sound, sound[-1] / 2)])


def calibrate(model: Model, told: DataFrame, known: DataFrame, fitted: DataFrame) -> None:
    """Set the thresholds from all known rows of told (doc_id, logit, tongue), counted in Spark by language, label and bin.

    Rows that were fitted score too well to place a cut and count for FITTED of a row; the rows are weighed up to those of
    their label. A language's cut is the mean of its own and the general one, weighed by its rows of the rarer label against
    POOL, so that few rows move it little and none not at all.
    """
    if not model.out.any():  # nothing was learnt
        return
    rows = told.join(known, "doc_id").join(F.broadcast(fitted.withColumn("fitted", F.lit(1))), "doc_id", "left")
    by = (F.coalesce("fitted", F.lit(0)).alias("fitted"), "tongue", "label", F.floor(F.asinh("logit") * STEPS).alias("bin"))
    found = np.array([tuple(r) for r in rows.groupBy(*by).count().collect()], dtype=np.int64).reshape(-1, 5)
    bins, place = np.unique(found[:, 3], return_inverse=True)
    counts = np.zeros((2, len(LANGUAGES), 2, len(bins)))
    counts[found[:, 0], found[:, 1], found[:, 2], place] = found[:, 4]
    whole, seen, cuts = counts.sum(axis=0), counts[0] + FITTED * counts[1], np.sinh(bins / STEPS)
    if not whole.sum(axis=(0, 2)).all():  # one label only: there is no cut between them
        return
    general = _threshold(seen.sum(axis=0), whole.sum(axis=(0, 2)), cuts)
    for t in range(len(LANGUAGES)):
        weight = seen[t].sum(axis=1).min()
        own = _threshold(seen[t], whole[t].sum(axis=1), cuts) if weight else general
        model.thresholds[t] = (weight * own + POOL * general) / (weight + POOL)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and label of the rows that are not held out; several labels count as toxic if one says so; nulls are dropped."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("label"))


def sampled(docs: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, label and text of the rows to fit, a bounded sample, the same for the same tables.

    Per label the documents of lowest hash outside the fifth that is kept from fitting, one row each: of rows that share a
    doc_id the smallest text is taken.
    """
    free = known.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(5)) != 0)
    parts = [free.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n) for y, n in ((1, settings.positives), (0, settings.negatives))]
    rows = docs.where(F.length("text") <= settings.max_chars).select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, known: DataFrame, settings: Settings) -> tuple[list, list[str], np.ndarray]:
    """What sampled gives, in the driver and in order."""
    return _columns(tuple(r) for r in sampled(docs, known, settings).collect())


def _columns(rows) -> tuple[list, list[str], np.ndarray]:
    found = sorted(rows)
    return [d for d, _, _ in found], [t for _, _, t in found], np.array([y for _, y, _ in found], dtype=np.int64)


def fitted_model(sample: DataFrame, settings: Settings) -> Model:
    """The model of the rows of a sample, fitted in one task of an executor: the driver gets neither the texts nor what training takes."""

    def run(batches):
        _, texts, truth = _columns(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))))
        model = pickle.dumps(train(texts, truth, settings))
        del texts
        release()
        yield pa.record_batch([pa.array([model], pa.binary())], names=["model"])

    made = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], np.zeros(0, dtype=np.int64), settings)  # no task without rows


def with_logits(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """Those columns with the logit and language code of every whole text, and whether it has no words; no shuffle.

    Null texts count as empty. The model (two tables of ``buckets`` rows, a few MB whatever the corpus) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inside = "text" in columns  # the text is sent once

    def run(batches):
        model = sent.value
        for batch in batches:
            for part in slices(with_text(batch) if inside else batch, most=SMALL_SLICE):
                codes, offsets, distinct = split_words(texts_of(part))
                words = words_of(distinct, model.settings.buckets)
                tongues = guess_languages(codes, offsets, words)
                logit = model.logits(codes, offsets, words).astype(np.float64)
                yield pa.record_batch([as_array(part.column("row")), pa.array(logit), pa.array(tongues.astype(np.int32)), pa.array(np.diff(offsets) == 0)], names=["row", "logit", "tongue", "bare"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *([] if inside else ["text"]))
    schema = StructType([rows.schema["row"]]).add("logit", "double").add("tongue", "integer").add("bare", "boolean")
    return rows.mapInArrow(run, schema)


def _score(model: Model) -> F.Column:
    threshold = F.element_at(F.array(*(F.lit(float(t)) for t in model.thresholds)), F.col("tongue") + 1)
    shifted = F.col("logit") - threshold + F.lit(float(np.log(CUT / (1 - CUT))))
    return 1 / (1 + F.exp(-F.greatest(F.least(shifted, F.lit(60.0)), F.lit(-60.0))))


def _scored(told: DataFrame, model: Model) -> DataFrame:
    scored = told.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), _score(model).alias("score"), "tongue")
    names = F.array(*map(F.lit, LANGUAGES))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.element_at(names, F.col("tongue") + 1).alias("language"))


def _clean(told: DataFrame, model: Model) -> DataFrame:
    return told.where(F.col("bare") | (_score(model) < CUT)).select("row.*")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text; no shuffle. An empty text gets the score of no evidence."""
    return _scored(with_logits(docs, model, ["doc_id"]), model)


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores below CUT; rows without text stay; an empty table stays empty."""
    return _clean(with_logits(docs, model, docs.columns), model)


def _judged(docs: DataFrame, labels: DataFrame, settings: Settings | None, columns: list[str]) -> tuple[DataFrame, Model]:
    """Logits of all rows, written once, and the model with thresholds from those of all labelled rows."""
    settings, known = settings or Settings(), labelled(labels)
    sample = written(sampled(docs, known, settings), "sample")
    model = fitted_model(sample, settings)
    told = written(with_logits(docs, model, columns), "logits")
    calibrate(model, told.select("row.doc_id", "logit", "tongue"), known, sample.select("doc_id"))
    return told, model


def classify(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Fit on the sample, calibrate on all labelled rows and score all documents: doc_id, held_out, score, predicted, language.

    docs: doc_id, text; labels: doc_id, toxic (others than 0 and 1 and null ids are ignored; of several the toxic one counts).
    Every row gets a score; a null or empty text that of no evidence; a null doc_id is not held out; rows that share a doc_id
    are scored each by their own text; other columns are ignored; without labels of both kinds all scores are low (or, with
    toxic ones only, high); an empty table gives an empty result.
    """
    return _scored(*_judged(docs, labels, settings, ["doc_id"]))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """clean_documents by the model that classify makes; docs must have a doc_id and a text; an empty table stays empty."""
    return _clean(*_judged(docs, labels, settings, docs.columns))
