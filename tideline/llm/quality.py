"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other, then score all documents together."""
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from . import winnow
from .common import bound_batches, read_table
from .registry import query

#: Documents that fitting may use, at most: so many labelled rows and so many rows without labels, by the smallest seeded hashes of their ids.
LABELLED, UNLABELLED = 4_000, 2_000
#: Hashed words of the content view, and of the metadata view.
CONTENT_DIM, META_DIM = 1 << 15, 1 << 10
#: Rounds of exchange, and pseudo-labels that a view hands over in each: so many a class, if it is at least so sure.
ROUNDS, HANDED, SURE = 3, 200, 0.95
#: Share of the labelled sample that is held out for calibration.
HELD_OUT = 0.2
#: Probability of quality up to which a document is rejected, and probability of toxicity from which it is.
REJECT_QUALITY, REJECT_TOXIC = 0.3, 0.6

_KINDS = np.zeros(256, np.int64)
_KINDS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_KINDS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KINDS[[ord(c) for c in "0123456789"]] = 3
_KINDS[[ord(c) for c in " \t\n\r\x0b\x0c"]] = 4
_KINDS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KINDS[128:] = 6


class Rows:
    """Sparse rows: columns and values one after another, and where each row begins."""

    def __init__(self, columns, values, starts, dim):
        self.columns, self.values, self.starts, self.dim = columns, values, starts, dim
        self.owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    def __len__(self):
        return len(self.starts) - 1

    def times(self, weights):
        return np.bincount(self.owner, self.values * weights[self.columns], len(self))

    def back(self, residuals):
        return np.bincount(self.columns, self.values * residuals[self.owner], self.dim)

    def take(self, rows):
        spans = [np.arange(self.starts[r], self.starts[r + 1]) for r in rows]
        at = np.concatenate(spans) if len(rows) else np.zeros(0, np.int64)
        return Rows(self.columns[at], self.values[at], np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64), self.dim)


def content_rows(texts, dim=CONTENT_DIM):
    """The content view: hashed lower-case words (square root of the count, rows of length one) and shares of character kinds and of repeated words."""
    columns, values, starts = [], [], [0]
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
        letter = (low >= 97) & (low <= 122) | (low >= 128) | (low >= 48) & (low <= 57)
        edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = winnow.span_hashes(low.astype(np.uint64), begin, end) if len(begin) else np.zeros(0, np.uint64)
        kinds, counts = np.unique(words, return_counts=True)
        place = (kinds % np.uint64(dim - 64)).astype(np.int64)
        weight = np.sqrt(counts)
        weight = weight / max(1e-9, np.sqrt((weight * weight).sum())) * 3
        shares = np.bincount(_KINDS[raw], minlength=7) / max(1, len(raw))
        extra = np.concatenate([shares, [len(kinds) / max(1, len(words)), (counts.max() if len(counts) else 0) / max(1, len(words)), 0.2]]) * 5
        columns += [place, dim - 64 + np.arange(len(extra))]
        values += [weight, extra]
        starts.append(starts[-1] + len(place) + len(extra))
    return Rows(np.concatenate(columns) if columns else np.zeros(0, np.int64), np.concatenate(values) if values else np.zeros(0), np.array(starts, np.int64), dim)


def metadata_rows(frame, dim=META_DIM):
    """The metadata view: language, source, length, and how the page is laid out (lines, their mean length), each as a hashed value; nulls are values."""
    columns = []
    for lang, source, text in zip(frame["lang"], frame["source"], frame["text"], strict=True):
        text = text or ""
        lines = text.count("\n") + 1
        named = (f"lang={lang}", f"source={source}", f"size={len(text).bit_length()}", f"lines={lines.bit_length()}",
                 f"line={(len(text) // lines).bit_length()}", "all")
        columns.append([xxhash.xxh3_64_intdigest(name) % dim for name in named])
    flat = np.array(columns, np.int64).reshape(-1)
    return Rows(flat, np.ones(len(flat)), np.arange(len(columns) + 1) * 6, dim)


def fit_logistic(rows, labels, steps=150, decay=1e-4):
    """Weights of a logistic regression by Nesterov's method on whole batches; classes weigh alike."""
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    cost = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / max(1, len(labels))
    rate = 4 / max(1.0, np.bincount(rows.owner, rows.values ** 2, len(rows)).max(initial=1.0))
    weights, ahead = np.zeros(rows.dim), np.zeros(rows.dim)
    for step in range(steps):
        slope = rows.back((sigmoid(rows.times(ahead)) - labels) * cost) + decay * ahead
        after = ahead - rate * slope
        ahead, weights = after + step / (step + 3) * (after - weights), after
    return weights


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def newton(x, labels, target, pull):
    """Weights of a small logistic regression that are pulled to ``target``, by Newton's method with steps that never raise the loss."""
    loss = lambda w: np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ w)).sum() + pull / 2 * ((w - target) ** 2).sum()
    by = target.copy()
    for _ in range(30):
        p = sigmoid(x @ by)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(target)), x.T @ (p - labels) + pull * (by - target))
        size = 1.0
        while size > 1e-6 and loss(by - size * step) > loss(by):
            size /= 2
        by = by - size * step if size > 1e-6 else by
    return by


def calibrate(scores, labels):
    """Slope and offset that turn the scores of held-out rows into probabilities."""
    return newton(np.stack([scores, np.ones(len(scores))], 1), labels, np.array([1.0, 0.0]), 0.5)


def cotrain(content, meta, labels, rounds=ROUNDS, handed=HANDED, sure=SURE):
    """Two calibrated views ``(weights, slope, offset)`` and the two weights of their combination.

    ``labels`` is 0, 1 or nan for each row. Each round, both views are fitted on what they have; of the rows without a label, each hands its
    surest ones, ``handed`` a class at most (and a tenth of the labelled rows), to the other. Calibration and combination use labelled rows that no view was fitted on.
    """
    known = np.flatnonzero(~np.isnan(labels))
    hold = known[np.arange(len(known)) % max(2, round(1 / HELD_OUT)) == 0]
    train = np.setdiff1d(known, hold)
    pool = np.flatnonzero(np.isnan(labels))
    views, teach, handed = (content, meta), [dict(), dict()], max(1, min(handed, len(train) // 10))
    models = [None, None]
    for turn in range(rounds + 1):
        for v, rows in enumerate(views):
            extra = np.array(sorted(teach[v]), np.int64)
            use = np.concatenate([train, extra])
            models[v] = fit_logistic(rows.take(use), np.concatenate([labels[train], [teach[v][i] for i in extra]]))
        if turn == rounds or not len(pool):
            break
        for v, rows in enumerate(views):
            slope, offset = calibrate(rows.take(hold).times(models[v]), labels[hold])
            chance = sigmoid(slope * rows.take(pool).times(models[v]) + offset)
            order = np.argsort(chance, kind="stable")
            for rank, label in ((order, 0.0), (order[::-1], 1.0)):
                sure_ones = [i for i in rank[:handed] if (chance[i] >= sure if label else chance[i] <= 1 - sure)]
                teach[1 - v].update({int(pool[i]): label for i in sure_ones})
    steps = [calibrate(rows.take(hold).times(models[v]), labels[hold]) for v, rows in enumerate(views)]
    logits = np.stack([np.clip(steps[v][0] * rows.take(hold).times(models[v]) + steps[v][1], -15, 15) for v, rows in enumerate(views)] + [np.ones(len(hold))], 1)
    blend = newton(logits, labels[hold], np.array([1.0, 0.0, 0.0]), 0.5)
    return {"weights": [m.astype(np.float32) for m in models], "steps": steps, "blend": blend}


def chances(model, content, meta):
    """Probabilities by content, by metadata and by both."""
    logits = [np.clip(s[0] * rows.times(w.astype(float)) + s[1], -15, 15) for rows, w, s in zip((content, meta), model["weights"], model["steps"], strict=True)]
    return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(model["blend"][0] * logits[0] + model["blend"][1] * logits[1] + model["blend"][2])


def gathered(columns, values, dim):
    """Sparse rows that were made on executors."""
    flat = np.concatenate([np.asarray(c, np.int64) for c in columns])
    starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int64)
    return Rows(flat, np.ones(len(flat)) if values is None else np.concatenate([np.asarray(v, float) for v in values]), starts, dim)


def fit(docs, labels, targets=("quality", "toxic"), labelled=LABELLED, unlabelled=UNLABELLED, seed=5):
    """One co-trained model for each label column. Only the bounded sample reaches the driver; a label that has one value only gives a constant."""
    names = [t for t in targets if t in labels.columns]
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(t).alias(t) for t in names])
    some = marks.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).orderBy("order", "doc_id").limit(labelled)
    rest = docs.select("doc_id").where("doc_id is not null").withColumn("order", F.xxhash64("doc_id", F.lit(seed + 1))).orderBy("order", "doc_id").limit(labelled + unlabelled)
    rest = rest.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").orderBy("order", "doc_id").limit(unlabelled)
    wanted = some.drop("order").unionByName(rest.select("doc_id"), allowMissingColumns=True)
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(wanted), "doc_id")

    def view(batches):
        for batch in batches:
            content, meta = content_rows(batch["text"]), metadata_rows(batch)
            cut = lambda values, rows, kind: np.split(values.astype(kind), rows.starts[1:-1]) if len(rows) else []
            yield batch[["doc_id", *names]].assign(columns=cut(content.columns, content, np.int32), values=cut(content.values, content, np.float32),
                                                   meta=cut(meta.columns, meta, np.int32))

    marked = ", ".join(f"{name} {dict(wanted.dtypes)[name]}" for name in names)
    frame = rows.mapInPandas(view, f"doc_id {dict(docs.dtypes)['doc_id']}, {marked}, columns array<int>, values array<float>, meta array<int>").toPandas()
    if not len(frame):
        return dict.fromkeys(names)
    frame = frame.sort_values("doc_id", kind="stable").reset_index(drop=True)
    content, meta = gathered(frame.pop("columns"), frame.pop("values"), CONTENT_DIM), gathered(frame.pop("meta"), None, META_DIM)
    models = {}
    for name in names:
        y = frame[name].to_numpy(float, na_value=np.nan)
        y = np.where(np.isnan(y), np.nan, (y > 0).astype(float))
        seen = y[~np.isnan(y)]
        models[name] = cotrain(content, meta, y) if len(seen) > 4 and 0 < seen.mean() < 1 else float(seen.mean()) if len(seen) else None
    return models


def score(docs, models):
    """Every row of ``docs``, all its columns, plus ``content, metadata, quality, toxic`` (probabilities) and ``verdict`` (keep or reject).

    A document is kept when quality is above and toxicity below its limit. Null or empty texts have no words: the shares of their characters and their
    metadata decide. Without labels quality is 1 and toxicity 0. Rows are judged one by one and whole; nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    extra = ["content", "metadata", "quality", "toxic", "verdict"]
    clash = [c for c in docs.columns if c in extra]
    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes if c not in clash)

    def run(batches):
        for batch in batches:
            batch = batch.drop(columns=clash)
            out = []
            for a, b in winnow.chunks([len(t) if t else 0 for t in batch["text"]], 1 << 20):
                part = batch.iloc[a:b]
                content, meta = content_rows(part["text"]), metadata_rows(part)

                def judged(name, otherwise, content=content, meta=meta, n=b - a):
                    model = models.get(name)
                    if isinstance(model, dict):
                        return chances(model, content, meta)
                    return tuple(np.full(n, otherwise if model is None else model) for _ in range(3))
                by_text, by_meta, quality = judged("quality", 1.0)
                toxic = judged("toxic", 0.0)[2]
                keep = (quality > REJECT_QUALITY) & (toxic < REJECT_TOXIC)
                out.append(part.assign(content=by_text, metadata=by_meta, quality=quality, toxic=toxic, verdict=np.where(keep, "keep", "reject")))
            yield pd.concat(out) if out else batch.assign(content=0.0, metadata=0.0, quality=0.0, toxic=0.0, verdict="")

    return docs.drop(*clash).mapInPandas(run, f"{fields}, content double, metadata double, quality double, toxic double, verdict string")


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    models = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", "lang", "source"), models).select("doc_id", "content", "metadata", "quality", "toxic", "verdict")
