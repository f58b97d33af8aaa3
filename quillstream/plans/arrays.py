"""Queries of padded and ragged arrays, distillation, clipped rollouts, fallbacks and reward managers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import jagged as J
from quillstream.functions import masked as M
from quillstream.operators import distillation as D
from quillstream.operators import metrics as X
from quillstream.operators import rewards as R
from quillstream.operators import shaping as S
from quillstream.plans.base import TOK, query, r6, read, rollouts

#: One row for each order with line items: lists of token values in order.
ARR = (
    TOK
    + """, arr AS (SELECT row_id, any_value(uid) AS uid, list(v ORDER BY t) AS v, list(m ORDER BY t) AS m, list(logp ORDER BY t) AS lp, list(old_logp
    ORDER BY t) AS ol,
  list(ref_logp ORDER BY t) AS rf, list(q ORDER BY t) AS q, list(adv ORDER BY t) AS a, list(r ORDER BY t) AS r, count(*) AS n FROM tok GROUP BY 1)"""
)


def _rows(spark, sf, *names):
    return rollouts(spark, sf, *names).where(F.size(names[0]) > 0)


def _dot(a):
    """Sum of i * x_i, from 1: a number that tells order."""
    return F.coalesce(M.array_sum(F.transform(a, lambda x, i: (i + 1) * x)), F.lit(0.0))


def dot_sql(a: str) -> str:
    return f"round(coalesce(list_sum(list_transform({a}, lambda x, i: i * x)), 0), 6) + 0.0"


COMPACT = "list_transform(list_filter(list_zip(v, m), lambda x: x[2] = 1), lambda x: x[1])"


@query(
    f"""WITH {ARR}, c AS (SELECT *, {COMPACT} AS k, len(list_filter(m, lambda x: x = 1)) AS ones FROM arr)
    SELECT row_id, len(k) AS kept, {dot_sql("k")} AS ragged,
      {dot_sql("list_transform(m, lambda x, i: CASE WHEN x = 1 THEN v[i] ELSE -1 END)")} AS repadded,
      {dot_sql("list_concat(list_transform(range(greatest(0, 12 - n)), lambda x: 0.5), v[greatest(n - 12, 0) + 1:])")} AS padded,
      {dot_sql("v[len(v) - ones + 1:]")} AS stripped, CAST({dot_sql("m[greatest(len(m) - 3, 0) + 1:]")} AS DOUBLE) AS mask_tail,
      {dot_sql("CASE WHEN n > 2 THEN v[n - 2:n - 1] ELSE v[1:2] END")} AS shifted,
      len(k) * (len(k) + 1) / 2.0 AS ones_dot, round(v[1] * n * (n + 1) / 2, 6) + 0.0 AS expanded FROM c"""
)
def jagged_padded(spark, sf):
    """Ragged to padded and back, masks, shifts and scalars laid over tokens."""
    x = _rows(spark, sf, "values", "response_mask").withColumn("k", J.compact("values", "response_mask"))
    return x.select(
        "row_id", F.size("k").cast("long").alias("kept"), r6(_dot("k")).alias("ragged"), r6(
            _dot(J.scatter("k", "response_mask", -1.0))
        ).alias("repadded"),
        r6(_dot(J.pad_left("values", 12, 0.5))).alias("padded"), r6(_dot(J.strip_left("values", "response_mask"))).alias("stripped"),
        r6(_dot(J.response_mask("response_mask", 3))).alias("mask_tail"), r6(_dot(J.response_of("values", F.lit(2)))).alias("shifted"),
        r6(_dot(J.ones(F.size("k")))).alias("ones_dot"), r6(_dot(J.expand(F.element_at("values", 1), F.size("values")))).alias("expanded"),
    )


@query(
    f"""WITH {ARR}, n AS (SELECT row_id, v, m, list_sum(m) AS n FROM arr), s AS (SELECT *, sum(n) OVER (ORDER BY row_id) - n AS start FROM n),
    e AS (SELECT row_id, start, unnest(list_transform(list_filter(list_transform(m, lambda x, i: [x, i - 1]), lambda p: p[1] = 1), lambda p, k: [p[2],
    k - 1])) AS p, v FROM s)
    SELECT row_id, CAST(p[1] AS BIGINT) AS t, CAST(start + p[2] AS BIGINT) AS place, v[p[1] + 1] AS value FROM e"""
)
def unpadded_tokens(spark, sf):
    """All valid tokens end to end, with their places: cumulative lengths without one global order."""
    return J.flatten_valid(_rows(spark, sf, "values", "response_mask"), "values", "response_mask")


SOFT = "list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))"


@query(
    f"""WITH {ARR}, p AS (SELECT *, {SOFT} AS p, list_transform(lp, lambda x: exp(x)) AS e FROM arr),
    k AS (SELECT *, list_reverse_sort(p)[1:3] AS b FROM p), z AS (SELECT *, list_transform(b, lambda x: x / list_sum(b)) AS c FROM k),
    t AS (SELECT *, list_filter(c, lambda x, i: coalesce(list_sum(c[1:i - 1]), 0) < 0.8) AS d
    FROM z), u AS (SELECT *, list_transform(d, lambda x: x / list_sum(d)) AS f FROM t),
    h AS (SELECT *, -list_sum(list_transform(p, lambda x: x * ln(x))) AS hp, list_sum(list_transform(p, lambda x: x * ln(x) * ln(x))) AS sp,
      -list_sum(list_transform(f, lambda x: x * ln(x))) AS hf, list_sum(list_transform(f, lambda x: x * ln(x) * ln(x))) AS sf FROM u)
    SELECT row_id, round(hp, 5) + 0.0 AS entropy, round(sp - hp * hp, 5) + 0.0 AS variance, round(hf, 5) + 0.0 AS cut_entropy, round(sf - hf * hf,
    5) + 0.0 AS cut_variance,
      round(list_sum(list_transform(list_zip(lp, rf), lambda x: exp(x[1]) * (x[1] - x[2]))), 5) + 0.0 AS forward,
      round(v[n] - list_max(v) - ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 5) + 0.0 AS last_log_prob,
      round(v[1] / 2.0 - list_max(v) / 2.0 - ln(list_sum(list_transform(v, lambda x: exp((x - list_max(v)) / 2.0)))), 5) + 0.0 AS cooled FROM h"""
)
def logit_functions(spark, sf):
    """Entropy and variance on whole and truncated distributions, forward KL, log probabilities, temperature."""
    x = _rows(spark, sf, "values", "log_probs", "ref_log_prob")
    # a distribution is made once for all that is asked of it
    x = x.withColumn("p", J.probabilities("values")).withColumn("c", J.truncated(F.col("p"), 3, 0.8))
    x = x.withColumns({"whole": J.entropy_and_variance(F.col("p")), "cut": J.entropy_and_variance(F.col("c"))})
    n = F.size("values") - 1
    return x.select(
        "row_id", r6("whole.h", 5).alias("entropy"), r6("whole.v", 5).alias("variance"), r6("cut.h", 5).alias("cut_entropy"), r6("cut.v", 5).alias("cut_variance"),
        r6(J.forward_kl("log_probs", "ref_log_prob"), 5).alias("forward"), r6(M.log_prob("values", n), 5).alias("last_log_prob"), r6(
            M.log_prob(J.tempered("values", 2.0), F.lit(0)), 5
        ).alias("cooled"),
    )


@query(
    f"""WITH {ARR}, b AS (SELECT row_id, list_transform(range(1, 4), lambda i: [lp[1], lp[1] * i, -lp[1]]) AS z, n % 3 AS y FROM arr)
    SELECT row_id, round(list_sum(list_transform(range(1, 3), lambda i: z[i][i] - list_max(z[i]) - ln(list_sum(list_transform(z[i],
    lambda x: exp(x - list_max(z[i]))))))), 5) + 0.0 AS total FROM b"""
)
def shifted_log_probs(spark, sf):
    """Log probabilities of a response, each by the logits of the place before it."""
    x = _rows(spark, sf, "log_probs").withColumn("a", F.element_at("log_probs", 1))
    logits = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array(F.col("a"), F.col("a") * i, -F.col("a")))
    ids = F.array(F.lit(2), F.lit(0), F.lit(1))
    return x.select("row_id", r6(M.array_sum(J.response_log_probs(logits, ids, F.lit(2))), 5).alias("total"))


@query(
    f"""WITH {TOK}, g AS (SELECT row_id, sum(m) AS n, count(*) AS w FROM tok GROUP BY 1), k AS (SELECT tok.*, n, n = 4 AS clipped FROM tok
    JOIN g USING (row_id))
    SELECT row_id, bool_or(clipped) AS clipped, round(sum(CASE WHEN clipped THEN 0 ELSE r END), 6) + 0.0 AS zeroed, NOT bool_or(clipped) AS stays
    FROM k GROUP BY 1"""
)
def clipped_rollouts(spark, sf):
    """Rollouts that used up the budget: told, with no reward, or gone."""
    x = _rows(spark, sf, "response_mask", "token_level_rewards")
    x = x.withColumn("clipped", S.is_clipped("response_mask", 4))
    kept = S.clipped_batch(x, "drop", 4).select("row_id", F.lit(True).alias("stays"))
    zeroed = S.clipped_rewards(x, "zero", "token_level_rewards", 4)
    return zeroed.join(kept, "row_id", "left").select(
        "row_id", "clipped", r6(M.array_sum("token_level_rewards")).alias("zeroed"), F.coalesce("stays", F.lit(False)).alias("stays")
    )


@query(
    f"""WITH {TOK}, g AS (SELECT row_id, sum(m) AS n FROM tok GROUP BY 1) SELECT count(*) FILTER (WHERE n = 4) AS count,
    round(avg(CASE WHEN n = 4 THEN 1.0 ELSE 0 END), 6) AS ratio,
    count(*) FILTER (WHERE n = 4) AS dropped_count, count(*) FILTER (WHERE n <> 4) AS kept_count FROM g"""
)
def clipped_metrics(spark, sf):
    return S.clipped_metrics(_rows(spark, sf, "response_mask"), "drop", 4).select("count", r6("ratio").alias("ratio"), "dropped_count", "kept_count")


@query(
    f"""WITH {ARR}, x AS (SELECT row_id, list_sum(r) AS reward, (n % 3) / 2.0 AS c, n % 2 = 0 AS inside, CASE WHEN uid % 4 = 0 THEN 0.1 ELSE 0 END AS bonus,
    r, CAST(list_sum(m) AS BIGINT) AS k FROM arr)
    SELECT row_id, c > 0 AND NOT inside AS mask, round(bonus + CASE WHEN bonus > 0 AND c > 0 AND abs(reward) <= 1e-7 THEN c ELSE 0 END,
    6) + 0.0 AS adjusted,
      round(r[greatest(k - 1, 0) + 1] + bonus + CASE WHEN bonus > 0 AND c > 0 AND abs(reward) <= 1e-7 THEN c ELSE 0 END, 6) + 0.0 AS at_last FROM x"""
)
def fallback_bonus(spark, sf):
    """Who is asked for a verdict, and the bonus at the last token of the response."""
    x = _rows(spark, sf, "token_level_rewards", "response_mask").withColumn("_n", F.size("token_level_rewards"))
    x = x.withColumns(
        {"constraint": (F.col("_n") % 3) / 2.0, "inside": F.col("_n") % 2 == 0, "bonus": F.when(F.col("uid") % 4 == 0, 0.1).otherwise(0.0)}
    )
    x = S.fallback_bonus(x, "token_level_rewards", "response_mask", "bonus", "constraint")
    at = F.greatest(M.mask_count("response_mask") - 1, F.lit(0)).cast("int")
    return x.select(
        "row_id", S.needs_judge(F.col("constraint"), F.col("inside")).alias("mask"), r6("adjustment").alias("adjusted"),
        r6(F.get("token_level_rewards", at)).alias("at_last")
    )


KL_SQL = {
    "kl": "logp - ref_logp", "k1": "logp - ref_logp", "abs": "abs(logp - ref_logp)", "mse": "0.5 * (logp - ref_logp) * (logp - ref_logp)", "k2": "0.5 * (logp - ref_logp) * (logp - ref_logp)",
    "low_var_kl": "greatest(-10, least(10, exp(greatest(-20, least(20, ref_logp - logp))) - greatest(-20, least(20, ref_logp - logp)) - 1))",
}
KL_SQL["k3"] = KL_SQL["low_var_kl"]


@query(
    f"WITH {TOK} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS kind, round(sum(greatest(-1, least(1, {e})) * m) / sum(m), 6) + 0.0 AS loss, round(min({e}) FILTER (WHERE m = 1), 6) + 0.0 AS loss_min, round(max({e}) FILTER (WHERE m = 1), 6) + 0.0 AS loss_max, round(avg(abs({e})) FILTER (WHERE m = 1), 6) + 0.0 AS abs_loss FROM tok"
        for k, e in KL_SQL.items()
    )
)
def distillation_losses(spark, sf):
    """Each registered estimator, clamped and aggregated, with its range."""
    x = _rows(spark, sf, "log_probs", "ref_log_prob", "response_mask").withColumnRenamed("ref_log_prob", "teacher_log_probs")
    out = None
    for kind in D.ESTIMATORS:
        loss = D.distill(x, kind, most=1.0).select(F.lit(kind).alias("kind"), r6("loss").alias("loss"))
        told = D.loss_metrics(D.DISTILLATION_LOSSES.get(kind)(x)).select(*[r6(c).alias(c) for c in ("loss_min", "loss_max", "abs_loss")])
        part = loss.join(F.broadcast(told))  # one row each
        out = part if out is None else out.union(part)
    return out


RATIO = "exp(greatest(-20, least(20, logp - old_logp)))"
PG = f"CASE WHEN a < 0 THEN least(-a * 3, greatest(-a * {RATIO}, -a * greatest(0.8, least(1.2, {RATIO})))) ELSE greatest(-a * {RATIO}, -a * greatest(0.8, least(1.2, {RATIO}))) END"


@query(
    f"""WITH {TOK}, k AS (SELECT *, -greatest(-2, least(2, logp - ref_logp)) AS a
    FROM tok), p AS (SELECT sum({PG} * m) / sum(m) AS pg, sum(greatest(-2, least(2, logp - ref_logp)) * m) / sum(m) AS d FROM k)
    SELECT round(pg, 6) + 0.0 AS policy_form, round(d, 6) + 0.0 AS supervised_form, round(pg + 0.5 * d, 6) + 0.0 AS composite,
    round((SELECT sum(greatest(q - 0.5, 0) * m) / sum(m) FROM tok), 6) + 0.0 AS topk FROM p"""
)
def distillation_forms(spark, sf):
    """As a policy gradient, as a supervised loss, both together, and the top-k form."""
    x = _rows(
        spark, sf, "log_probs", "ref_log_prob", "old_log_probs", "sum_pi_squared", "response_mask"
    ).withColumnRenamed("ref_log_prob", "teacher_log_probs")
    x = x.withColumn("topk_loss", F.transform("sum_pi_squared", lambda v: v - 0.5))
    pg = D.distill(x, "k1", most=2.0, policy="vanilla").withColumnRenamed("loss", "pg")
    both = pg.join(F.broadcast(D.distill(x, "k1", most=2.0).withColumnRenamed("loss", "d"))).join(
        F.broadcast(D.distill(x, "forward_kl_topk").withColumnRenamed("loss", "k"))
    )
    return both.select(
        r6("pg").alias("policy_form"), r6("d").alias("supervised_form"),
        r6(D.with_policy_terms(F.col("d"), F.col("pg"), True, 0.5)).alias("composite"), r6("k").alias("topk")
    )


@query(
    f"""WITH {TOK}, x AS (SELECT CAST(l_partkey % 4 AS DOUBLE) AS c, CAST(l_suppkey % 8 AS DOUBLE) / 8 AS a, CAST(l_partkey % 16 AS DOUBLE) / 16 AS s,
    CAST(l_suppkey % 16 AS DOUBLE) / 16 AS t FROM lineitem)
    SELECT round(avg(c) / 4, 6) AS overlap_ratio, round(avg(a) FILTER (WHERE c > 0), 6) AS overlap_token_advantage, round(avg(s),
    6) AS student_mass_mean, min(s) AS student_mass_min, max(s) AS student_mass_max,
      round(avg(t), 6) AS teacher_mass_mean, min(t) AS teacher_mass_min, max(t) AS teacher_mass_max FROM x"""
)
def distillation_overlap(spark, sf):
    li = read(spark, sf, "lineitem")
    x = li.select(
        (F.col("l_partkey") % 4.0).alias("overlap_count"), (F.col("l_suppkey") % 8 / 8.0).alias("overlap_advantage"),
        (F.col("l_partkey") % 16 / 16.0).alias("student_mass"), (F.col("l_suppkey") % 16 / 16.0).alias("teacher_mass")
    )
    m = D.overlap_metrics(x, 4)
    return m.select(*[r6(c).alias(c) if "mean" in c or "overlap" in c else c for c in m.columns])


def _responses(spark, sf):
    """Turns of conversations as responses: a number after hashes, its truth, and a length."""
    c = read(spark, sf, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    return c.select(
        k.alias("conv_id"), t.alias("turn"), F.when(k % 2 == 0, "even").otherwise("odd").alias("data_source"), F.concat(
            F.lit("so #### "), (k % 7).cast("string"), F.when(k % 3 == 0, "<end>").otherwise("")
        ).alias("response_text"),
        F.when(
            k % 5 == 0, F.concat(F.lit("so #### "), (k % 7).cast("string"))
        ).otherwise((k % 4).cast("string")).alias("ground_truth"), (k % 9 + 1).alias("response_length"), F.when(k % 11 == 0, 0.25).alias("rm_scores"),
    )


ANSWERS = """a AS (SELECT conv_id, turn, 'so #### ' || (conv_id % 7) || CASE WHEN conv_id % 3 = 0 THEN '<end>' ELSE '' END AS x,
    CASE WHEN conv_id % 5 = 0 THEN 'so #### ' || (conv_id % 7) ELSE CAST(conv_id % 4 AS VARCHAR) END AS g,
  conv_id % 9 + 1 AS n, CASE WHEN conv_id % 11 = 0 THEN 0.25::DOUBLE END AS rm FROM conversations),
  b AS (SELECT *, CASE WHEN x = g THEN 1::DOUBLE ELSE 0 END AS exact, CASE WHEN CAST(conv_id % 7 AS VARCHAR) = g THEN 1::DOUBLE ELSE 0 END AS hash,
    CASE WHEN replace(x, '<end>', '') = g THEN 1::DOUBLE ELSE 0 END AS bare, least(-(n - 4) / 5.0 * 0.5, 0) AS late FROM a)"""


@query(
    f"""WITH {ANSWERS} SELECT conv_id, turn, exact AS naive, CASE WHEN conv_id % 2 = 0 THEN exact ELSE hash END AS by_source, round(bare + late,
    6) + 0.0 AS dapo, late < 0 AS overlong, exact + hash AS gdpo, coalesce(rm, exact) AS existing,
    hash AS tolerant, CASE WHEN conv_id % 6 = 5 THEN 0 ELSE hash END AS limited, hash AS remote, n AS size, round(bare + late, 6) + 0.0 AS at_last
    FROM b"""
)
def reward_managers(spark, sf):
    """Every manager on the same responses; the reward array has the score at its last place."""
    x, key = _responses(spark, sf), ["conv_id", "turn"]
    get = R.REWARD_MANAGERS.get
    both = R.by_source({"even": "exact", "odd": "hash"})
    parts = {
        "naive": get("naive")(x, R.exact), "by_source": get("batch")(x, both), "gdpo": get("gdpo")(x, {"a": R.exact, "b": R.by_hash}), "existing": R.existing_or(x, lambda d: get("naive")(d, R.exact)),
        "tolerant": get("prime")(x, R.by_hash), "limited": get("limited")(
            x, R.by_hash, (F.col("conv_id") % 6).cast("double"), 4.5
        ), "remote": get("remote")(x, R.by_hash, 4),
    }
    dapo = R.extra_columns(get("dapo")(x, R.exact, limit=9, buffer=5, factor=0.5, end="<end>"), ["overlong"])
    out = dapo.select(
        *key, r6("reward_score").alias("dapo"), (F.col("overlong") == 1).alias("overlong"), F.size("token_level_scores").cast("long").alias("size"),
        r6(F.element_at("token_level_scores", -1)).alias("at_last")
    )
    for name, part in parts.items():
        out = out.join(part.select(*key, F.col("reward_score").alias(name)), key)
    return out


@query(
    """SELECT doc_id, round(((CASE WHEN contains(text, ',') THEN 0 ELSE 1 END) + (CASE WHEN contains(text, '.') THEN 0 ELSE 1 END)) / 2.0 * 3, 6) AS score,
    ((CASE WHEN contains(text, ',') THEN 0 ELSE 1 END) + (CASE WHEN contains(text, '.') THEN 0 ELSE 1 END)) / 2.0 AS acc FROM documents
    WHERE trim(text) <> ''"""
)
def constraint_reward(spark, sf):
    """The constraint share as a reward function with a coefficient: score and accuracy."""
    d = read(spark, sf, "documents").where("trim(text) <> ''").select(
        "doc_id", F.col("text").alias("response_text"), F.lit("").alias("ground_truth"), F.lit(3).alias("response_length")
    )
    x = R.extra_columns(R.naive(d, R.constraints([("punctuation:no_comma", {}), ("punctuation:punctuation_dot", {})], 3.0)), ["acc"])
    return x.select("doc_id", r6("reward_score").alias("score"), "acc")


@query("SELECT conv_id, arg_max(turn::DOUBLE, turn) AS score FROM conversations GROUP BY 1")
def last_sequence_reward(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") * 1.0).alias("score"))
    return R.last_of_sequences(c, "conv_id", "turn").select("conv_id", "score")


@query(
    """WITH x AS (SELECT l_orderkey AS row_id, l_partkey % 4 AS a, l_suppkey % 4 AS b, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS m FROM lineitem)
    SELECT row_id, count(*) FILTER (WHERE a <> b AND m = 1) AS differ FROM x GROUP BY 1"""
)
def token_differences(spark, sf):
    """How many valid tokens of a row differ between two engines."""
    li = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), (F.col("l_partkey") % 4).alias("a"), (F.col("l_suppkey") % 4).alias("b"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("m")
    )
    rows = li.groupBy("row_id").agg(F.collect_list(F.struct("a", "b", "m")).alias("x"))
    part = lambda n: F.transform("x", lambda e: e[n])
    return rows.select("row_id", X.token_differences(part("a"), part("b"), part("m")).alias("differ"))


@query(
    f"""WITH {TOK} SELECT round(corr(logp, rollout_logp) FILTER (WHERE m = 1), 5) AS pearson, round(max(abs(exp(logp) - exp(rollout_logp))) FILTER (WHERE m =
    1), 6) AS most FROM tok"""
)
def masked_pearson(spark, sf):
    x = _rows(spark, sf, "log_probs", "rollout_log_probs", "response_mask")
    return X.pearson(x, "log_probs", "rollout_log_probs", "response_mask").select(r6("pearson", 5).alias("pearson"), r6("most").alias("most"))


@query(
    f"""WITH {ARR} SELECT row_id, round(list_sum(list_transform(list_zip(v, m), lambda x: x[1] * x[2])) / (list_sum(m) + 1e-8) + 1e-6, 5) + 0.0 AS mean,
    round(CASE WHEN list_sum(m) > 1 THEN list_var_samp({COMPACT}) END + 1e-6, 5) + 0.0 AS variance, len(m) AS seen FROM arr"""
)
def masked_moments(spark, sf):
    x = _rows(spark, sf, "values", "response_mask")
    return x.select(
        "row_id", r6(M.masked_mean("values", "response_mask") + 1e-6, 5).alias("mean"),
        r6(M.masked_var("values", "response_mask") + 1e-6, 5).alias("variance"), F.size("values").cast("long").alias("seen")
    )


@query(
    f"""WITH {ARR}, x AS (SELECT row_id, list_transform(v, lambda e: CAST(e * 4 AS BIGINT)) AS ids, n FROM arr)
    SELECT row_id, len(list_filter(ids, lambda e, i: list_position(ids, 3) IS NULL OR list_position(ids, 3) = 0 OR i <= list_position(ids,
    3))) AS ones,
    CAST(list_sum(list_transform(ids[1:3], lambda e, i: i * e)) AS BIGINT) AS right_cut, CAST(list_sum(list_transform(ids[greatest(n - 2, 1):],
    lambda e, i: i * e)) AS BIGINT) AS left_cut,
    CAST(list_sum(list_transform(CASE WHEN n > 3 THEN list_concat(ids[1:1], ids[n - 1:]) ELSE ids END, lambda e, i: i * e)) AS BIGINT) AS middle_cut,
    len(ids[1:6]) + greatest(0, 6 - n) AS padded FROM x"""
)
def token_id_arrays(spark, sf):
    """Masks up to the first end token, cuts on either side and in the middle, padding."""
    x = _rows(spark, sf, "values").withColumn("ids", F.transform("values", lambda e: (e * 4).cast("long")))
    dot = lambda a: F.aggregate(F.transform(a, lambda e, i: e * (i + 1)), F.lit(0).cast("long"), lambda s, e: s + e)
    cut = lambda side: dot(M.truncate("ids", 3, side))
    return x.select(
        "row_id", M.mask_count(M.response_mask_from_eos("ids", F.lit(3).cast("long"))).alias("ones"), cut("right").alias("right_cut"),
        cut("left").alias("left_cut"), cut("middle").alias("middle_cut"), F.size(M.pad_right("ids", 6, 0)).cast("long").alias("padded")
    )
