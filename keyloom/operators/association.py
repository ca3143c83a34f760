"""Within-key and between-key parts of each term's association with a score, their null, and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.numeric import correlation
from keyloom.functions.ordering import attach, hash_rank, mid_ranks, ordered, running
from keyloom.functions.permutation import permuted
from keyloom.functions.tdist import two_sided_p
from keyloom.operators.terms import match_terms
from keyloom.session import cut_lineage

GAP_TYPES = ("inflated", "sign_reversed", "attenuated")
NO_SLOPE, NO_DIFFERENCE = 1e-12, 1e-9
# Digits after the point to which values are compared in rank correlations.
RANK_DIGITS = 9
# Documents whose places are sent to all tasks.
MOST_PLACES = 1_000_000


def key_term_counts(uses: DataFrame, key: str, term: str = "term") -> DataFrame:
    """Documents of each key that contain each term; ``uses`` has one row per document and distinct term."""
    return uses.groupBy(key, term).agg(F.count(F.lit(1)).alias("c"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 1e-12, top / bottom)


def key_means(documents: DataFrame, key: str, score: str) -> DataFrame:
    """Documents and mean score of each key. Counts every document, also those without any term."""
    return documents.groupBy(key).agg(F.count(F.lit(1)).alias("n_k"), F.avg(score).alias("s_k"))


def association_decomposition(
    documents: DataFrame, uses: DataFrame, key: str, score: str, term: str = "term"
) -> DataFrame:
    """Pooled, within-key and between-key slope of the score on each term, from sufficient statistics.

    ``documents`` holds one row per document with its key and score; ``uses`` repeats key and score on one row
    per document and distinct term. Two aggregations, on (key, term) and on term; no centred second pass.
    """
    whole = documents.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s")).alias("whole")).scalar()
    cells = uses.groupBy(key, term).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(score).cast("double")).alias("zs"))
    cells = attach(cells, key_means(documents, key, score), [key], "inner")
    sums = cells.groupBy(term).agg(
        F.sum("c").alias("df"),
        F.count(F.lit(1)).alias("client_frequency"),
        F.sum("zs").alias("zs"),
        F.sum(F.col("c") * F.col("s_k")).alias("cs"),
        F.sum(F.col("c") * F.col("c") / F.col("n_k")).alias("c2"),
    )
    sums = sums.withColumn("whole", whole)
    n, mean, df = F.col("whole.n"), F.col("whole.s"), F.col("df")
    ss_total, ss_within, ss_between = df - df * df / n, df - F.col("c2"), F.col("c2") - df * df / n
    cov_total, cov_within, cov_between = F.col("zs") - df * mean, F.col("zs") - F.col("cs"), F.col("cs") - df * mean
    pooled, within = _ratio(cov_total, ss_total), _ratio(cov_within, ss_within)
    return sums.select(
        term,
        df.alias("document_frequency"),
        "client_frequency",
        pooled.alias("beta_pooled"),
        within.alias("beta_within"),
        _ratio(cov_between, ss_between).alias("beta_between"),
        _ratio(ss_within, ss_total).alias("lambda_within"),
        (pooled - within).alias("gap"),
        _ratio(cov_between, df).alias("exposure"),
        (ss_between / n).alias("between_client_variance"),
    )


def shuffled_keys(documents: DataFrame, doc: str, key: str, score: str, repeats: int, seed: object) -> DataFrame:
    """For every document, the keys its text is moved to: ``repeats`` seeded shuffles among equal scores.

    Documents of one score are ranked once, in hash order. In draw r the document of rank i takes the place of rank p(i),
    p being the permutation keyed by seed, draw and score. The places are few numbers per document: they are broadcast up to
    ``MOST_PLACES`` documents and shuffled beyond.
    """
    ranked = hash_rank(documents.select(doc, key, score), [score], [doc], f"{seed}|base", rank="__i", size="__n")
    ranked = cut_lineage(ranked.withColumn("__i", F.col("__i") - 1))
    places = ranked.select(score, "__i", F.col(key).alias("__to"))
    if ranked.count() <= MOST_PLACES:
        places = F.broadcast(places)
    draws = ranked.select(doc, score, "__i", "__n", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))
    draws = draws.select(doc, score, "rep", permuted(F.col("__i"), F.col("__n"), F.lit(str(seed)), F.col("rep"), F.col(score)).alias("__i"))
    moved = attach(draws, places, [score, "__i"], "inner")
    return moved.groupBy(doc).agg(F.collect_list(F.struct("rep", F.col("__to").alias("to"))).alias("moves"))


def permutation_gaps(
    documents: DataFrame, uses: DataFrame, decomposition: DataFrame, doc: str, key: str, score: str,
    repeats: int, seed: object, term: str = "term",
) -> DataFrame:
    """Gap of each term in each draw: ``(rep, term, gap)``. Terms not in ``decomposition`` are left out.

    Moving text among equal scores changes neither a term's frequency nor its pooled slope, so only the
    within-key sums are recomputed. Terms and keys are numbered first: the rows of all draws hold numbers only.
    """
    means = cut_lineage(key_means(documents, key, score).withColumn("__k", F.monotonically_increasing_id()))
    placed = attach(documents.select(doc, key, score), means.select(key, "__k"), [key], "inner")
    moves = shuffled_keys(placed, doc, "__k", score, repeats, seed)
    listed = cut_lineage(decomposition.select(term, F.col("document_frequency").alias("df"), "beta_pooled", F.monotonically_increasing_id().alias("__t")))
    wanted = match_terms(uses.select(doc, term), listed.select(term, "df", "__t"), term, "df").select(doc, "__t")
    cells = (
        attach(wanted, moves, [doc], "inner")
        .select("__t", F.explode("moves").alias("m"))
        .groupBy(F.col("m.rep").alias("rep"), F.col("m.to").alias("__k"), "__t")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    cells = cells.join(means.select("__k", "n_k", "s_k"), "__k")
    drawn = cells.groupBy("rep", "__t").agg(
        F.sum(F.col("c") * F.col("s_k")).alias("cs"), F.sum(F.col("c") * F.col("c") / F.col("n_k")).alias("c2")
    )
    mean = documents.agg(F.avg(score)).scalar()
    n = documents.agg(F.count(F.lit(1))).scalar()
    joined = drawn.join(listed, "__t").withColumn("n", n).withColumn("mean", mean)
    df = F.col("df")
    cov_total = F.col("beta_pooled") * (df - df * df / F.col("n"))
    zs = cov_total + df * F.col("mean")
    within = _ratio(zs - F.col("cs"), df - F.col("c2"))
    return joined.select("rep", term, (F.col("beta_pooled") - within).alias("gap"))


def permutation_null(
    documents: DataFrame, uses: DataFrame, decomposition: DataFrame, doc: str, key: str, score: str,
    repeats: int, seed: object, term: str = "term",
) -> DataFrame:
    """Mean and sample standard deviation of each term's gap if text depended on the score but not on the key."""
    gaps = permutation_gaps(documents, uses, decomposition, doc, key, score, repeats, seed, term)
    return gaps.groupBy(term).agg(F.avg("gap").alias("null_mean"), F.stddev_samp("gap").alias("null_sd"))


def benjamini_hochberg(
    df: DataFrame, p: str, row: Sequence[str], family: Sequence[str] = (), out: str = "q"
) -> DataFrame:
    """False-discovery-rate adjusted p-values within each family; NULL p-values stay NULL and do not count."""
    family = list(family)
    tested = ordered(df, family, [F.col(p).asc_nulls_last(), *row], rank="__rank")
    tests = tested.groupBy(*family).agg(F.count(p).alias("__m"))
    tested = attach(tested, tests, family, "inner") if family else tested.withColumn("__m", tests.scalar())
    raw = F.col(p) * F.col("__m") / F.col("__rank")
    adjusted = running(tested, family, "__rank", raw, "min", "__least", backward=True)
    value = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("__least")))
    return adjusted.withColumn(out, value).drop("__rank", "__m", "__block", "__least")


def flag_terms(
    decomposition: DataFrame, null: DataFrame, repeats: int, min_document_frequency: int, min_client_frequency: int,
    fdr: float, term: str = "term",
) -> DataFrame:
    """Standardised gap, its q-value, and what kind of structure it shows.

    The gap is measured in null standard deviations widened for the finite number of draws and referred to
    Student's t with ``repeats - 1`` degrees of freedom.
    """
    scale = F.col("null_sd") * F.sqrt(F.lit(1.0 + 1.0 / repeats))
    supported = (F.col("document_frequency") >= min_document_frequency) & (
        F.col("client_frequency") >= min_client_frequency
    )
    tested = (
        decomposition.join(null, term, "left")
        .withColumn("supported", supported)
        .withColumn("gap_z", F.when(F.col("supported") & (scale > 0), (F.col("gap") - F.col("null_mean")) / scale))
        .withColumn("gap_p", two_sided_p(F.col("gap_z"), F.lit(repeats - 1)))
    )
    adjusted = benjamini_hochberg(cut_lineage(tested), "gap_p", [term], out="gap_q")  # a sort reads its input twice
    return gap_type(adjusted.withColumn("client_structure", F.coalesce(F.col("gap_q") <= fdr, F.lit(False))))


def gap_type(flagged: DataFrame) -> DataFrame:
    """Direction of the difference between pooled and within-key slope, and whether the term is a candidate.

    Slopes are sums of rounded terms: below ``NO_SLOPE`` a slope has no sign, and a relative difference below
    ``NO_DIFFERENCE`` is none, so that the order of summation cannot decide.
    """
    pooled, within = F.col("beta_pooled"), F.col("beta_within")
    both = F.least(F.abs(pooled), F.abs(within)) > NO_SLOPE
    kind = (
        F.when(~F.col("client_structure"), "")
        .when((pooled * within < 0) & both, "sign_reversed")
        .when(F.abs(pooled) > F.abs(within) * (1 + NO_DIFFERENCE) + NO_SLOPE, "inflated")
        .otherwise("attenuated")
    )
    typed = flagged.withColumn("gap_type", kind)
    return typed.withColumn("candidate", F.col("gap_type").isin("inflated", "sign_reversed"))


def sentiment_direction(parameters: DataFrame, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Signed coefficient per feature: class weights contrasted with the centred class index."""
    centre = (classes - 1) / 2.0
    factor = 2.0 if classes == 2 else 1.0
    weights = parameters.where(F.col("layer") == "weight")
    return weights.groupBy(*by, "idx").agg(
        (F.sum((F.col("class") - F.lit(centre)) * F.col("value")) * factor).alias("direction")
    )


def bias_statistics(df: DataFrame, by: Sequence[str], model: str, reference: str, exposure: str, mask: Column) -> DataFrame:
    """Relation between a model's coefficient bias and key exposure, over the masked rows of each group.

    Spearman's ranks compare values rounded to ``RANK_DIGITS`` digits: values that differ by the order of summation only
    are ties.
    """
    by = list(by)
    rows = df.where(mask & F.col(exposure).isNotNull()).select(
        *by,
        (F.col(model) - F.col(reference)).alias("b"),
        F.col(exposure).alias("x"),
        F.col(reference).alias("c"),
        F.col(model).alias("w"),
    )
    rows = cut_lineage(rows)
    rows = rows.withColumns({f"__{c}": F.round(F.col(c), RANK_DIGITS) + F.lit(0.0) for c in "bx"})
    rows = cut_lineage(mid_ranks(rows, by, {"__b": "rank_b", "__x": "rank_x"}).drop("__b", "__x"))
    first = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_features"),
        correlation("b", "x").alias("r"),
        correlation("rank_b", "rank_x").alias("rho"),
        F.avg(F.abs("b")).alias("mean_abs_bias"),
        F.stddev_pop("b").alias("sd_b"),
        F.stddev_pop("x").alias("sd_x"),
        F.sum(F.col("c") * F.col("c")).alias("cc"),
        F.sum(F.col("w") * F.col("c")).alias("wc"),
        F.regr_slope("b", "c").alias("slope_b"),
        F.regr_slope("x", "c").alias("slope_x"),
        F.avg("b").alias("mean_b"),
        F.avg("x").alias("mean_x"),
        F.avg("c").alias("mean_c"),
    )
    away = F.col("c") - F.col("mean_c")
    residual = attach(rows, first, by, "inner").select(
        *by,
        (F.col("b") - F.col("mean_b") - F.coalesce("slope_b", F.lit(0.0)) * away).alias("rb"),
        (F.col("x") - F.col("mean_x") - F.coalesce("slope_x", F.lit(0.0)) * away).alias("rx"),
    )
    second = residual.groupBy(*by).agg(
        correlation("rb", "rx").alias("partial"), F.stddev_pop("rb").alias("sd_rb"), F.stddev_pop("rx").alias("sd_rx")
    )
    joined = attach(first, second, by, "inner")
    usable = (F.col("num_features") >= 3) & (F.col("sd_b") > 0) & (F.col("sd_x") > 0)
    scaled = usable & (F.col("cc") > 0)
    varied = (F.col("sd_rb") > 1e-9 * F.col("sd_b")) & (F.col("sd_rx") > 1e-9 * F.col("sd_x"))
    return joined.select(
        *by,
        "num_features",
        F.when(usable, F.col("r")).alias("pearson"),
        F.when(usable, F.col("rho")).alias("spearman"),
        F.when(scaled & varied, F.col("partial")).alias("partial_pearson"),
        "mean_abs_bias",
        F.when(scaled, F.col("wc") / F.col("cc")).alias("scale_ratio"),
    )


def gap_type_counts(flagged: DataFrame) -> DataFrame:
    """Features, supported features, structured features and candidates, and the number of each gap type."""
    count = lambda c: F.count_if(c)
    return flagged.agg(
        F.count(F.lit(1)).alias("num_features"),
        count(F.col("supported")).alias("num_supported"),
        count(F.col("client_structure")).alias("num_structured"),
        count(F.col("candidate")).alias("num_candidates"),
        *[count(F.col("gap_type") == name).alias(name) for name in GAP_TYPES],
    )


def candidate_weight(flagged: DataFrame, directions: Sequence[str]) -> DataFrame:
    """Mean absolute direction of each model over the candidate terms; NULL without candidates."""
    return flagged.agg(*[F.avg(F.when(F.col("candidate"), F.abs(name))).alias(name) for name in directions])


def feature_table(
    vocabulary: DataFrame, flagged: DataFrame, directions: dict[str, DataFrame], reference: str
) -> DataFrame:
    """One row per vocabulary term: association, null, flags, and every model's direction and bias.

    ``directions`` maps a model name to ``(idx, direction)``; biases are taken against ``reference``.
    """
    table = vocabulary.select("idx", "term").join(flagged, "term", "left")
    for name, direction in directions.items():
        table = table.join(direction.select("idx", F.col("direction").alias(f"w_{name}")), "idx", "left")
    for name in directions:
        table = table.withColumn(f"w_{name}", F.coalesce(f"w_{name}", F.lit(0.0)))
    for name in directions:
        if name != reference:
            table = table.withColumn(f"coefficient_bias_{name}", F.col(f"w_{name}") - F.col(f"w_{reference}"))
    return table
