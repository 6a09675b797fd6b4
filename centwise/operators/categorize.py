"""Expense categoriser: TF-IDF + multinomial naive Bayes as joins and aggregates
(ML1-ML9, SRC7, SET1, SET2, SNK12).

Model (alpha = 1, empirical class priors, smoothed idf, L2-normalised rows):

    idf(t)      = ln((1 + n) / (1 + df(t))) + 1
    x(d, t)     = tf(d, t) * idf(t) / ||tf(d, .) * idf(.)||
    fc(c, t)    = sum of x(d, t) over training docs of class c
    logp(c, t)  = ln(fc(c, t) + 1) - ln(sum_t fc(c, t) + V)
    score(c, d) = ln(prior(c)) + sum_t x(d, t) * logp(c, t)

Because ln(0 + 1) = 0, the score splits into a sparse part over the terms a
class has actually seen plus ``-ln(sum fc + V) * sum_t x(d, t)``; so the model
is stored sparsely (``nb_term``: class x seen term) and no dense
vocabulary x class table is ever built.  Everything is a groupBy or an
equi-join on ``term``.  The terms that most documents share are broadcast, as many as
``BROADCAST_BYTES`` hold; only what is left of a document, its rare terms, is shuffled by term.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centwise.functions.stop_words import ENGLISH_STOP_WORDS

# Token pattern -- runs of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Health keywords that force the Health category (substring match).
HEALTH_KEYWORDS = ["medical", "hospital", "clinic", "doctor", "pharmacy", "medicine", "checkup",
                   "dental", "physio", "therapy", "counsel", "vaccin", "lab test", "blood test"]
HEALTH_PATTERN = "(" + "|".join(HEALTH_KEYWORDS) + ")"

# Parts of each unit step of the summed term weights in which classes are compared (see ``_unseen``).
WEIGHT_STEPS = 4
# The most frequent terms are broadcast up to so many bytes, with so many for the rest of a row.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 48
# Terms are ranked by so many steps for each unit of idf.
IDF_STEPS = 16
# Bytes of text whose terms a task counts at once, and weights it scores at once.
TASK_TEXT = 2 << 20
TASK_WEIGHTS = 250_000


def english_stop_words() -> tuple[str, ...]:
    """Spark ML's English stop-word list (a module constant, no file access)."""
    return ENGLISH_STOP_WORDS


def tokens(col: F.Column) -> F.Column:
    """ML1: lower-case word runs of length >= 2."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), 0)


def _no_stop_word(col: F.Column, stop_words) -> F.Column:
    """ML2: true where ``col`` is no stop word.  The list is a parameter of the caller
    (181 words by default), tested as a hash set inside the generated code."""
    words = list(english_stop_words() if stop_words is None else stop_words)
    return ~col.isin(words) if words else F.lit(True)


def _counted(words: F.Column) -> F.Column:
    """array<struct<term, tf>> of an array of words: sorted, each run's end found, its length taken.
    A word becomes no row of its own.  Arrays of one element bind what the functions inside look up."""
    def ends(s):
        return F.filter(F.transform(s, lambda t, i: F.when((i == F.size(s) - 1) | (F.get(s, i + 1) != t), i)),
                        lambda i: i.isNotNull())

    def runs(s, e):
        return F.transform(e, lambda at, j: F.struct(
            F.get(s, at).alias("term"), (at - F.coalesce(F.get(e, j - 1), F.lit(-1))).cast("long").alias("tf")))

    bind = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    return bind(F.sort_array(words), lambda s: bind(ends(s), lambda e: runs(s, e)))


def _packed(terms: F.Column) -> list[F.Column]:
    """array<struct<term, tf>> as a text and an array of numbers, which take a fraction of its bytes
    in a shuffle.  No term holds a blank."""
    return [F.array_join(F.transform(terms, lambda t: t["term"]), " ").alias("words"),
            F.transform(terms, lambda t: t["tf"].cast("int")).alias("tfs")]


def _unpacked(docs: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, tf) from ``_packed``."""
    terms = F.transform(F.split("words", " "), lambda t, i: F.struct(t.alias("term"), F.get("tfs", i).alias("tf")))
    return docs.where(F.size("tfs") > 0).select(*key, F.explode(terms).alias("t")).select(*key, "t.term", "t.tf")


def _weighed(tf: DataFrame, vocab: DataFrame, how: str) -> DataFrame:
    return tf.join(vocab, "term", how).withColumn("w", F.col("tf") * F.col("idf"))


def _sums(*more: F.Column) -> list[F.Column]:
    return [F.sum(F.col("w") * F.col("w")).alias("sq"), F.sum("w").alias("sum"), *more]


def _left() -> F.Column:
    """The terms of a document that got no weight from the frequent ones.  A text bounds them."""
    return F.collect_list(F.when(F.col("w").isNull() & F.col("term").isNotNull(), F.struct("term", "tf"))).alias("left")


def _left_terms(docs: DataFrame, key: list[str]) -> DataFrame:
    return docs.select(*key, F.explode("left").alias("t")).select(*key, "t.term", "t.tf")


@dataclass
class NBModel:
    vocab: DataFrame   # term, idf
    prior: DataFrame   # category, doc_count, log_prior, log_den
    term: DataFrame    # category, term, log_num
    parts: list = field(default_factory=list)   # what ``_term_parts`` found, for the next documents


def training_frame(seed: DataFrame | None, expenses: DataFrame | None) -> DataFrame:
    """SRC6/SRC7 + SET1: seed rows union expense rows, rows with a null dropped.

    Exact duplicates (SET2) are removed inside ``train`` by hash key, so the
    texts themselves are never shuffled."""
    parts = [p.select(F.col("description").cast("string"), F.col("category").cast("string"))
             for p in (seed, expenses) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropna()


def _doc_key() -> F.Column:
    """128 bits of category and text."""
    return F.unhex(F.md5(F.concat_ws("\u0001", "category", "description")))


def term_counts(training: DataFrame, stop_words=None) -> DataFrame:
    """SET2 + ML1 + ML2: (doc, category, terms array<struct<term, tf>>), a row for each distinct row of
    (description, category).

    Each distinct text is shuffled once, by its hash key (copies collapse before that); its terms are
    counted in its row."""
    keyed = training.select("description", "category").dropna().withColumn("doc", _doc_key())
    texts = keyed.groupBy("doc", "category").agg(F.first("description").alias("description"))
    words = F.filter(tokens(F.col("description")), lambda t: _no_stop_word(t, stop_words))
    return texts.select("doc", "category", _counted(words).alias("terms"))


def _split(vocab: DataFrame, rows: F.Column | int = 1) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent terms of a vocabulary (term, idf) whose ``rows`` take ``BROADCAST_BYTES`` at most,
    and the others, if there are any.  The idf falls with the frequency; its steps are a few hundred."""
    step = F.floor(F.col("idf") * IDF_STEPS)
    sizes = (vocab.groupBy(step.alias("step")).agg(F.sum((F.octet_length("term") + ROW_BYTES) * rows).alias("size"))
             .orderBy("step").collect())
    total, last = 0, None
    for r in sizes:
        total += r["size"]
        if total > BROADCAST_BYTES:
            cut = F.lit(False) if last is None else step <= last
            return vocab.where(cut), vocab.where(~cut)
        last = r["step"]
    return vocab, None


def _term_parts(spark: SparkSession, model: NBModel) -> list[DataFrame | None]:
    """The rows of ``nb_term``, each with its term's idf in its weight, of the frequent terms, to be
    broadcast; those terms; and the rows of the others.  A term has as many rows as classes at most,
    and as documents.  Found once for a model."""
    from centwise.session import materialize
    if not model.parts:
        n, classes = model.prior.agg(F.sum("doc_count"), F.count(F.lit(1))).first()
        df = F.round((1.0 + (n or 0)) / F.exp(F.col("idf") - 1.0) - 1.0)
        common, rare = _split(model.vocab, F.greatest(F.lit(1.0), F.least(df, F.lit(float(classes)))))
        rows = lambda v: model.term.join(v, "term").select("term", "category", (F.col("idf") * F.col("log_num")).alias("by"))
        if rare is None:
            model.parts = [materialize(spark, rows(common), "nb_common_term"), None, None]
        else:
            common = materialize(spark, common, "nb_common")
            model.parts = [materialize(spark, rows(F.broadcast(common)), "nb_common_term"), common.select("term"),
                           materialize(spark, rows(rare), "nb_rare_term")]
    return model.parts


def _terms(docs: DataFrame) -> DataFrame:
    return docs.select("doc", "category", F.explode("terms").alias("t")).select("doc", "category", "t.term", "t.tf")


def fit(spark: SparkSession, docs: DataFrame) -> NBModel:
    """ML4 + ML5 + ML6: the model tables from stored ``term_counts``."""
    from centwise.session import materialize
    n_docs, n_terms = docs.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    dfreq = _terms(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vocab = materialize(spark, dfreq.select(
        "term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")), "nb_vocab")
    v = vocab.count()
    common, rare = _split(vocab)
    key = ["doc", "category"]
    tf = _unpacked(docs.select(*key, *_packed(F.col("terms"))).repartition(1 + (n_terms or 0) // TASK_WEIGHTS, "doc"), key)
    listed = F.collect_list(F.when(F.col("w").isNotNull(), F.struct("term", "w"))).alias("ws")
    w = _weighed(tf, F.broadcast(common), "left")
    d = w.groupBy(*key).agg(*_sums(listed))
    if rare is not None:                                   # only the terms left are shuffled, by term and back
        left = _left_terms(w.groupBy(*key).agg(_left()), key)
        more = _weighed(left, rare, "inner").groupBy("doc").agg(*_sums(listed))
        d = d.alias("a").join(more.alias("b"), "doc", "left").select(
            "doc", "category", F.concat("a.ws", F.coalesce("b.ws", F.array().cast(d.schema["ws"].dataType))).alias("ws"),
            (F.coalesce("a.sq", F.lit(0.0)) + F.coalesce("b.sq", F.lit(0.0))).alias("sq"))
    x = (d.select("category", F.sqrt("sq").alias("norm"), F.explode("ws").alias("t"))
         .select("category", "t.term", (F.col("t.w") / F.col("norm")).alias("x")))
    fc = materialize(spark, x.groupBy("category", "term").agg(F.sum("x").alias("fc")), "nb_fc")
    classes = docs.groupBy("category").agg(F.count(F.lit(1)).alias("doc_count"))
    tot = fc.groupBy("category").agg(F.sum("fc").alias("fc_total"))
    prior = classes.join(tot, "category", "left").select(
        "category", "doc_count",
        F.log(F.col("doc_count") / F.lit(float(n_docs))).alias("log_prior"),
        F.log(F.coalesce(F.col("fc_total"), F.lit(0.0)) + F.lit(float(v))).alias("log_den"),
    )
    term = fc.select("category", "term", F.log(F.col("fc") + 1.0).alias("log_num"))
    return NBModel(vocab=vocab, prior=prior, term=term)


def train(spark: SparkSession, training: DataFrame, stop_words=None) -> NBModel:
    """ML4 + ML6 (+ SET2): fit the model tables from (description, category).  The term counts are
    written once to the shared folder; the model tables are small aggregates of them."""
    from centwise.session import materialize
    return fit(spark, materialize(spark, term_counts(training, stop_words), "nb_tf"))


def save(model: NBModel, path: str) -> None:
    """SNK12: the model is three parquet tables."""
    model.vocab.write.mode("overwrite").parquet(f"{path}/nb_vocab")
    model.prior.write.mode("overwrite").parquet(f"{path}/nb_prior")
    model.term.write.mode("overwrite").parquet(f"{path}/nb_term")


def load(spark: SparkSession, path: str) -> NBModel:
    """SRC9: read a saved model."""
    return NBModel(vocab=spark.read.parquet(f"{path}/nb_vocab"),
                   prior=spark.read.parquet(f"{path}/nb_prior"),
                   term=spark.read.parquet(f"{path}/nb_term"))


def materialize(spark: SparkSession, model: NBModel, name: str = "nb_model") -> NBModel:
    """Write the model tables to the shared checkpoint folder and read them
    back: later jobs read three small tables instead of re-running training."""
    from centwise.session import shared_path
    path = shared_path(spark, name)
    save(model, path)
    return load(spark, path)


STRIP = r"^\s+|\s+$"


def _doc_weights(spark: SparkSession, model: NBModel, docs: DataFrame, key: str, text: str, stop_words,
                 flags: bool) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: (key[, blank, health], words, tfs, left) with the terms (``_packed``) and
    those that are not frequent, and (key[, blank, health], norm, sx) with the norm of the weights and
    their sum after normalising (ML5).  Both are written once to the shared folder.

    Every document keeps its row, those without a known term too (sx 0).  A text is shuffled once, by
    its key; the frequent terms are counted and weighed where it lies, the others shuffled by term."""
    from centwise.session import materialize
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    d = docs.select(key, F.regexp_replace(F.col(text), STRIP, "").alias("_t")).repartition(1 + size // TASK_TEXT, key)
    group = [key]
    if flags:
        # Per-document flags are computed *before* the explode; in the same
        # select Catalyst would evaluate them above the Generate, once per token.
        d = d.select(key, "_t", (F.col("_t") == "").alias("blank"),
                     F.lower("_t").rlike(HEALTH_PATTERN).alias("health"))
        group += ["blank", "health"]
    e = d.select(*group, F.explode_outer(tokens(F.col("_t"))).alias("term"))
    e = e.withColumn("term", F.when(_no_stop_word(F.col("term"), stop_words), F.col("term")))
    tf = e.groupBy(*group, "term").agg(F.count("term").alias("tf"))
    common, rare = _split(model.vocab)
    words = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    own = _weighed(tf, F.broadcast(common), "left").groupBy(*group).agg(*_sums(words.alias("terms"), _left()))
    own = materialize(spark, own.select(*group, "sq", "sum", *_packed(F.col("terms")), "left"), "nb_words")
    sums = own.select(*group, "sq", "sum")
    if rare is not None:
        more = _weighed(_left_terms(own, group), rare, "inner").groupBy(*group).agg(*_sums())
        sums = sums.unionByName(more).groupBy(*group).agg(F.sum("sq").alias("sq"), F.sum("sum").alias("sum"))
    norm = F.sqrt(F.col("sq"))
    sums = sums.select(*group, norm.alias("norm"), F.coalesce(F.col("sum") / norm, F.lit(0.0)).alias("sx"))
    return own, materialize(spark, sums, "nb_sums")


def _step(sx: F.Column) -> F.Column:
    """The step of a document's summed weights; documents without a known term have their own."""
    return F.when(sx > 0, F.floor(sx * WEIGHT_STEPS)).otherwise(F.lit(-1))


def _unseen(model: NBModel, top: int | None) -> DataFrame:
    """(step, category, log_prior, log_den): per step of ``sx`` the classes that can be best
    by ``log_prior - log_den * sx`` alone.

    That score is a line in ``sx``, so a class below another one at both ends of a step is
    below it all through the step.  Few classes are left per step; steps number four per
    unit of the longest document's summed weights, whose step is ``top``."""
    steps = F.sequence(F.lit(-1).cast("long"), F.lit(-1 if top is None else top).cast("long"))
    c = model.prior.select("category", "log_prior", "log_den", F.explode(steps).alias("step"))
    lo = F.greatest(F.col("step"), F.lit(0)) / WEIGHT_STEPS
    hi = (F.col("step") + 1) / WEIGHT_STEPS
    c = (c.withColumn("at_lo", F.col("log_prior") - F.col("log_den") * lo)
         .withColumn("at_hi", F.col("log_prior") - F.col("log_den") * hi))
    order = Window.partitionBy("step").orderBy(
        F.col("at_lo").desc(), F.when(F.col("step") >= 0, F.col("at_hi")).desc(), "category")
    above = F.max("at_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(order)
    c = c.withColumn("above", above).withColumn("nth", nth)
    c = c.filter((F.col("nth") == 1) | ((F.col("step") >= 0) & (F.col("at_hi") > F.col("above"))))
    return c.select("step", "category", "log_prior", "log_den")


def _score(spark: SparkSession, model: NBModel, words: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """ML7 on ``_doc_weights``.

    A document meets only the classes that share a term with it, and the few that can be
    best without one (``_unseen``).  The latter may share a term too: their score without
    it is lower than the one with it (every log_num is positive), so the maximum holds."""
    top, n_docs = sums.agg(F.max(_step(F.col("sx"))), F.count(F.lit(1))).first()
    n_words = words.agg(F.sum(F.size("tfs"))).first()[0]
    tasks = 1 + max(n_words or 0, n_docs) // TASK_WEIGHTS
    common, names, rare = _term_parts(spark, model)
    dot = F.sum(F.col("tf") * F.col("by")).alias("dot")
    # with its row in one task, a document's terms are added up there
    spread = words.select(key, "words", "tfs").repartition(tasks, key)
    dots = _unpacked(spread, [key]).join(F.broadcast(common), "term").groupBy(key, "category").agg(dot)
    if rare is not None:
        more = (_unpacked(words, [key]).join(F.broadcast(names), "term", "left_anti").join(rare, "term")
                .groupBy(key, "category").agg(dot))
        dots = dots.unionByName(more).groupBy(key, "category").agg(F.sum("dot").alias("dot"))
    prior = model.prior.select("category", "log_prior", "log_den")
    spread = sums.select(key, "norm", "sx").repartition(tasks, key)
    base = F.col("log_prior") - F.col("log_den") * F.col("sx")
    seen = (dots.join(spread, key).join(prior, "category")
            .select(key, "category", (base + F.col("dot") / F.col("norm")).alias("score")))
    rest = spread.withColumn("step", _step(F.col("sx"))).join(_unseen(model, top), "step").select(key, "category", base.alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("low"), F.col("category"))).alias("best")
    return (seen.groupBy(key).agg(best).unionByName(rest.groupBy(key).agg(best)).groupBy(key).agg(F.min("best").alias("best"))
            .select(key, F.col("best.category").alias("predicted"), (-F.col("best.low")).alias("score")))


def predict(spark: SparkSession, model: NBModel, docs: DataFrame, key: str = "doc_id",
            text: str = "description", stop_words=None) -> DataFrame:
    """ML7: arg-max class per document; ties -> first class by name; a text
    with no known token gets the highest prior.  Returns (key, predicted, score), a row per
    key: rows of equal key count as one text."""
    return _score(spark, model, *_doc_weights(spark, model, docs, key, text, stop_words, flags=False), key)


def auto_categorize(spark: SparkSession, model: NBModel, docs: DataFrame, key: str = "doc_id",
                    text: str = "description", stop_words=None) -> DataFrame:
    """ML9: blank -> Other; a health keyword -> Health; else the model's class.
    The texts are read once: flags and terms come from the same pass.  ``key`` must be unique:
    rows of equal key count as one text, and come once for each pair of flags they have."""
    words, sums = _doc_weights(spark, model, docs, key, text, stop_words, flags=True)
    flags = sums.select(key, "blank", "health")
    asked = ~F.col("blank") & ~F.col("health")
    ml = _score(spark, model, words.filter(asked), sums.filter(asked), key)
    return (flags.join(ml, key, "left")
            .select(key, F.when(F.col("blank"), F.lit("Other")).when(F.col("health"), F.lit("Health"))
                    .otherwise(F.col("predicted")).alias("category")))
