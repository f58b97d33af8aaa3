"""Queries of estimators, losses and off-policy correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import masked as M
from quillstream.operators import advantage as A
from quillstream.operators import losses as L
from quillstream.operators import offpolicy as O
from quillstream.plans.base import ROWS, TOK, query, r6, read, rollouts, tokens

U = "OVER (PARTITION BY uid)"
WHITE = "(SELECT sum(x * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n, sum(x * m) AS sx, sum(x * x * m) AS sq FROM raw)"
WHITEN = "(x - mu) / sqrt((sq - 2 * mu * sx + n * mu * mu) / (n + 1e-8) * n / (n - 1) + 1e-8)"


def _scalar(df):
    """The sum of a row's advantages, which is its scalar times its tokens."""
    return df.select("row_id", r6(M.array_sum("advantages"), 4).alias("adv"))


def _times(df, known, places: int = 4):
    """A row's scalar times its tokens, null where the scalar is not ``known``, rounded as the SQL does it: the sum of as many
    copies of the scalar is another double, and near ties of the last place a round of the shortest decimal is another one."""
    high, low = F.array_max("advantages"), F.array_min("advantages")
    x = F.coalesce(F.when(high > 0, high).otherwise(low) * M.mask_count("response_mask"), F.lit(0.0))
    return df.select("row_id", F.when(known, F.signum(x) * F.floor(F.abs(x) * 10.0**places + 0.5) / 10.0**places + F.lit(0.0)).alias("adv"))


def _rows(expr: str) -> str:
    return f"WITH {ROWS}, e AS (SELECT row_id, n, {expr} AS a FROM rows) SELECT row_id, round(a * n, 4) + 0.0 AS adv FROM e"


def _basic(spark, sf):
    return rollouts(spark, sf, "token_level_rewards", "response_mask")


@query(_rows(f"CASE WHEN count(*) {U} > 1 THEN (s - avg(s) {U}) / (stddev_samp(s) {U} + 1e-6) ELSE s / (1 + 1e-6) END"))
def grpo(spark, sf):
    return _scalar(A.grpo(_basic(spark, sf)))


@query(_rows(f"CASE WHEN count(*) {U} > 1 THEN s - avg(s) {U} ELSE s END"))
def grpo_nostd(spark, sf):
    return _scalar(A.grpo(_basic(spark, sf), norm_by_std=False))


@query(_rows(f"CASE WHEN count(*) {U} > 1 THEN (s - avg(s) {U}) / (stddev_samp(s) {U} + 1e-6) ELSE s / (1 + 1e-6) END"))
def grpo_vectorized(spark, sf):
    return _scalar(A.compute(_basic(spark, sf), "grpo_vectorized"))


@query(_rows(f"CASE WHEN count(*) {U} > 1 THEN (count(*) {U} * s - sum(s) {U}) / (count(*) {U} - 1) ELSE s END"))
def rloo(spark, sf):
    return _scalar(A.rloo(_basic(spark, sf)))


@query(_rows(f"CASE WHEN count(*) {U} > 1 THEN (count(*) {U} * s - sum(s) {U}) / (count(*) {U} - 1) ELSE 0 END"))
def rloo_vec(spark, sf):
    return _scalar(A.rloo_vectorized(_basic(spark, sf)))


@query(_rows(f"CASE WHEN count(*) {U} > 1 THEN s - sum(n * s) {U} / nullif(sum(n) {U}, 0) ELSE s END"))
def opo(spark, sf):
    # rows of a group without any tokens have no mean weighted by lengths
    weights, rows = F.sum(M.mask_count("response_mask")).over(A.group()), F.count(F.lit(1)).over(A.group())
    df = _basic(spark, sf).withColumn("known", (rows == 1) | (weights > 0))
    return _times(A.opo(df), F.col("known"))


@query(
    f"""WITH {ROWS}, g AS (SELECT *, count(*) {U} AS k FROM rows), e AS (SELECT row_id, n,
  CASE WHEN row_number() OVER w = 1 THEN (s - lead(s) OVER w) / (stddev_samp(s) {U} + 1e-6) ELSE 0 END AS a FROM g
    WHERE k > 1 WINDOW w AS (PARTITION BY uid ORDER BY s DESC, row_id))
  SELECT row_id, round(a * n, 4) + 0.0 AS adv FROM e"""
)
def passk(spark, sf):
    df = _basic(spark, sf).withColumn("k", F.count("*").over(A.group())).where("k > 1").drop("k")
    return _scalar(A.grpo_passk(df))


@query(
    f"""WITH {ROWS}, a AS (SELECT greatest(1, count(*) FILTER (WHERE s <> 0)) AS z, count(*) AS c
    FROM rows), e AS (SELECT row_id, n, CAST(c AS DOUBLE) / z * (CASE WHEN count(*) {U} > 1 THEN s - avg(s) {U} ELSE s END) AS a FROM rows, a)
  SELECT row_id, round(a * n, 4) + 0.0 AS adv FROM e"""
)
def gpg(spark, sf):
    return _scalar(A.gpg(_basic(spark, sf)))


@query(
    f"""WITH {ROWS}, b AS (SELECT *, CASE WHEN count(*) {U} > 1 THEN s - avg(s) {U} ELSE s END AS a FROM rows), raw AS (SELECT b.row_id, t, a AS x, m FROM b
    JOIN tok USING (row_id)), w AS {WHITE}
  SELECT row_id, t, round({WHITEN} * m, 5) + 0.0 AS adv FROM raw, w"""
)
def reinforce_baseline(spark, sf):
    return _long(A.reinforce_plus_plus_baseline(_basic(spark, sf)))


def _long(df, places: int = 5):
    return df.select("row_id", F.posexplode("advantages").alias("t", "a")).select(
        "row_id", F.col("t").cast("long").alias("t"), r6("a", places).alias("adv")
    )


@query(
    f"""WITH {TOK}, g AS (SELECT row_id, t, m, sum(r * m) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x
    FROM tok)
  SELECT row_id, t, x - (row_id % 5) * m AS adv FROM g"""
)
def remax(spark, sf):
    df = _basic(spark, sf).withColumn("reward_baselines", (F.col("row_id") % 5).cast("double"))
    return A.remax(df).select("row_id", F.posexplode("advantages").alias("t", "adv")).withColumn("t", F.col("t").cast("long"))


@query(
    f"""WITH RECURSIVE {TOK}, k AS (SELECT row_id, max(t) AS k FROM tok GROUP BY 1),
  raw0 AS (SELECT tok.row_id, t, m, r AS x FROM tok JOIN k ON tok.row_id = k.row_id AND t = k.k
   UNION ALL SELECT tok.row_id, tok.t, tok.m, tok.r + 0.5 * raw0.x * raw0.m FROM raw0 JOIN tok ON tok.row_id = raw0.row_id AND tok.t = raw0.t - 1),
  raw AS (SELECT * FROM raw0), w AS {WHITE}
  SELECT row_id, t, round({WHITEN} * m, 5) + 0.0 AS adv FROM raw, w"""
)
def reinforce_pp(spark, sf):
    return _long(A.reinforce_plus_plus(_basic(spark, sf), gamma=0.5))


@query(
    f"""WITH RECURSIVE {TOK}, k AS (SELECT row_id, max(t) AS k FROM tok GROUP BY 1),
  raw0 AS (SELECT tok.row_id, t, m, CASE WHEN m = 1 THEN r - v ELSE 0 END AS x, CASE WHEN m = 1 THEN v ELSE 0 END AS nv FROM tok
    JOIN k ON tok.row_id = k.row_id AND t = k.k
   UNION ALL SELECT tok.row_id, tok.t, tok.m, CASE WHEN tok.m = 1 THEN tok.r + 0.5 * nv - tok.v + 0.25 * raw0.x ELSE raw0.x END,
    CASE WHEN tok.m = 1 THEN tok.v ELSE nv END FROM raw0 JOIN tok ON tok.row_id = raw0.row_id AND tok.t = raw0.t - 1),
  raw AS (SELECT * FROM raw0), w AS {WHITE}
  SELECT row_id, t, round({WHITEN} * m, 5) + 0.0 AS adv FROM raw, w"""
)
def gae(spark, sf):
    return _long(A.gae(rollouts(spark, sf, "token_level_rewards", "response_mask", "values"), gamma=0.5, lam=0.5))


def _baseline_sql(compact: bool) -> str:
    place = "sum(m) OVER (PARTITION BY row_id ORDER BY t) - 1" if compact else "t"
    only = "WHERE m = 1" if compact else ""
    some = "WHERE n > 0" if compact else ""
    return f"""WITH {ROWS}, a AS (SELECT row_id, uid, t, m, sum(r * m) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
    sum((1 - 2 * exp(old_logp) + q) * m) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w, {place} AS p
    FROM tok),
  b AS (SELECT *, sum(g * w * m) OVER (PARTITION BY uid, p) / (sum(w * m) OVER (PARTITION BY uid, p) + 1e-8) AS base FROM a {only}),
  k AS (SELECT uid, n, row_number() OVER (PARTITION BY uid ORDER BY n DESC, row_id) AS k FROM rows {some}),
  u AS (SELECT uid, count(*) AS c, max(n) FILTER (WHERE k = 2) AS second FROM k GROUP BY 1)
  SELECT tok.row_id, tok.t, round(coalesce(CASE WHEN c < 2 OR p >= second THEN 0 ELSE (g - base) * b.m END, 0), 3) + 0.0 AS adv FROM tok LEFT JOIN (b
    JOIN u USING (uid)) ON tok.row_id = b.row_id AND tok.t = b.t"""


def _baseline(spark, sf, compact):
    t = tokens(spark, sf, "uid", "t", "r", "m", "old_logp", "q")
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"))
    made = A.token_baseline(t, rows, compact).select("row_id", "t", "advantage")
    if compact:  # masked tokens have 0
        made = t.select("row_id", "t").join(made, ["row_id", "t"], "left")
    return made.select("row_id", "t", r6(F.coalesce("advantage", F.lit(0.0)), 3).alias("adv"))


@query(_baseline_sql(False))
def otb(spark, sf):
    return _baseline(spark, sf, False)


@query(_baseline_sql(True))
def tir_otb(spark, sf):
    return _baseline(spark, sf, True)


@query(_baseline_sql(False))
def otb_arrays(spark, sf):
    """The same from rows of arrays."""
    return _long(
        A.compute(rollouts(spark, sf, "token_level_rewards", "response_mask", "old_log_probs", "sum_pi_squared"), "optimal_token_baseline"), 3
    )


@query(_baseline_sql(True))
def tir_otb_arrays(spark, sf):
    return _long(
        A.compute(rollouts(spark, sf, "token_level_rewards", "response_mask", "old_log_probs", "sum_pi_squared"), "tir_optimal_token_baseline"), 3
    )


@query(
    f"""WITH {ROWS}, b AS (SELECT row_id, CASE WHEN count(*) {U} > 1 THEN (s - avg(s) {U}) / (greatest(stddev_samp(s) {U}, 0) + 1e-6) ELSE s / (1 + 1e-6) END
   + 0.5 * CASE WHEN count(*) {U} > 1 THEN (n - avg(n) {U}) / (greatest(stddev_samp(n) {U}, 0) + 1e-6) ELSE n / (1 + 1e-6) END AS a FROM rows),
  raw AS (SELECT b.row_id, t, a AS x, m FROM b JOIN tok USING (row_id)), w AS {WHITE}
  SELECT row_id, t, round({WHITEN} * m, 5) + 0.0 AS adv FROM raw, w"""
)
def gdpo(spark, sf):
    df = _basic(spark, sf).withColumn("c1", M.array_sum("token_level_rewards")).withColumn("c2", M.mask_count("response_mask").cast("double"))
    return _long(A.gdpo(df, ["c1", "c2"], [1.0, 0.5]))


@query(
    """WITH x AS (SELECT conv_id % 50 AS uid, conv_id AS session, turn, length(text) % 17 AS score, max(turn) OVER (PARTITION BY conv_id % 50,
    conv_id) AS last FROM conversations WHERE role <> 'system'),
  l AS (SELECT *, CASE WHEN turn = last THEN score END AS x FROM x),
  g AS (SELECT *, (x - CASE WHEN count(x) OVER (PARTITION BY uid) > 1 THEN avg(x) OVER (PARTITION BY uid) ELSE 0 END) / (CASE
    WHEN count(x) OVER (PARTITION BY uid) > 1 THEN stddev_samp(x) OVER (PARTITION BY uid) ELSE 1 END + 1e-6) AS a FROM l)
  SELECT session, turn, round(max(a) OVER (PARTITION BY uid, session), 5) + 0.0 AS adv FROM g"""
)
def last_turn_broadcast(spark, sf):
    from quillstream.plans.base import read

    c = read(spark, sf, "conversations").where("role <> 'system'")
    df = c.select((F.col("conv_id") % 50).alias("uid"), F.col("conv_id").alias("session"), "turn", (F.length("text") % 17).alias("score"))
    return A.last_turn_advantage(df).select("session", "turn", r6("advantage", 5).alias("adv"))


@query(
    f"""WITH {TOK}, k AS (SELECT row_id, sum(greatest(-10, least(10, exp(greatest(-20, least(20, ref_logp - old_logp))) - greatest(-20, least(20,
    ref_logp - old_logp)) - 1)) * m) AS k, sum(m) AS n, sum(r) AS r FROM tok GROUP BY 1)
  SELECT o_orderkey AS row_id, round(coalesce(r - 0.5 * k, 0), 6) + 0.0 AS reward, round(coalesce(k, 0) / (coalesce(n, 0) + 1e-8), 6) + 0.0 AS kl
    FROM orders LEFT JOIN k ON row_id = o_orderkey"""
)
def kl_reward(spark, sf):
    df = rollouts(
        spark, sf, "token_level_rewards", "response_mask", "old_log_probs", "ref_log_prob"
    ).withColumnRenamed("token_level_rewards", "token_level_scores")
    return A.kl_in_reward(df, 0.5, "low_var_kl").select("row_id", r6(M.array_sum("token_level_rewards")).alias("reward"), r6("mean_kl").alias("kl"))


def _loss_tokens(spark, sf):
    return tokens(spark, sf).withColumnsRenamed({"m": "mask"})


RATIO = "exp(greatest(-20, least(20, logp - old_logp)))"
VANILLA = f"CASE WHEN adv < 0 THEN least(-adv * 3, greatest(-adv * {RATIO}, -adv * greatest(0.8, least(1.2, {RATIO})))) ELSE greatest(-adv * {RATIO}, -adv * greatest(0.8, least(1.2, {RATIO}))) END"


def _mean_sql(expr: str) -> str:
    return f"WITH {TOK} SELECT round(sum(({expr}) * m) / sum(m), 6) + 0.0 AS loss FROM tok"


def _loss(spark, sf, f, mode: str = "token-mean", **k):
    return L.agg_loss(f(_loss_tokens(spark, sf), **k), mode=mode).select(r6("loss").alias("loss"))


@query(_mean_sql(VANILLA))
def ppo_clip(spark, sf):
    return _loss(spark, sf, L.vanilla)


@query(
    _mean_sql(
        "CASE WHEN CASE WHEN adv > 0 THEN exp(logp) - exp(old_logp) <= 0.2 ELSE exp(logp) - exp(old_logp) >= -0.2 END THEN -adv * least(" + RATIO + ", 20) ELSE 0 END"
    )
)
def dppo_tv(spark, sf):
    return _loss(spark, sf, L.dppo_tv)


_KLD = "(exp(old_logp) * (old_logp - logp) + (1 - exp(old_logp)) * (ln(greatest(1 - exp(old_logp), 1e-12)) - ln(greatest(1 - exp(logp), 1e-12))))"


@query(
    _mean_sql(
        f"CASE WHEN CASE WHEN adv > 0 THEN exp(logp) <= exp(old_logp) OR {_KLD} <= 0.05 ELSE exp(logp) >= exp(old_logp) OR {_KLD} <= 0.05 END THEN -adv * least({RATIO}, 20) ELSE 0 END"
    )
)
def dppo_kl(spark, sf):
    return _loss(spark, sf, L.dppo_kl)


@query(
    f"""WITH {TOK}, g AS (SELECT *, exp(least(10, sum((logp - old_logp) * m) OVER (PARTITION BY row_id) / greatest(1,
    sum(m) OVER (PARTITION BY row_id)))) AS q1 FROM tok)
  SELECT round(sum(greatest(-adv * q1, -adv * greatest(0.9, least(1.1, q1))) * m) / sum(m), 6) + 0.0 AS loss FROM g"""
)
def gspo(spark, sf):
    return _loss(spark, sf, L.gspo, low=0.1, high=0.1)


@query(_mean_sql(f"-adv * 4 / (CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END) / (1 + exp(-(CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END) * ({RATIO} - 1)))"))
def sapo(spark, sf):
    return _loss(spark, sf, L.sapo)


@query(_mean_sql("-logp * adv"))
def gpg_loss(spark, sf):
    return _loss(spark, sf, L.gpg)


@query(_mean_sql(f"-greatest(0.8, least(1.2, {RATIO})) * adv * logp"))
def cispo(spark, sf):
    return _loss(spark, sf, L.cispo)


@query(
    f"""WITH {TOK}, g AS (SELECT row_id, sum(CASE WHEN sign(adv) > 0 THEN least(logp - old_logp, 0.4) ELSE greatest(logp - old_logp, -0.4) END * m) AS d,
    sum(adv * m) AS a, sum(m) AS n FROM tok GROUP BY 1)
  SELECT round(avg(-exp(d / (n + 1e-8)) * a / (n + 1e-8)), 6) + 0.0 AS loss FROM g"""
)
def geo_mean(spark, sf):
    return _loss(spark, sf, L.geo_mean)


@query(
    f"""WITH {TOK}, g AS (SELECT sum(-adv * logp * m) AS s, sum(m) AS n FROM tok GROUP BY row_id) SELECT round(avg(s), 6) + 0.0 AS loss FROM g WHERE n > 0"""
)
def reinforce_loss(spark, sf):
    return _loss(spark, sf, L.reinforce, "seq-mean-token-sum")


@query(
    f"""WITH {TOK}, g AS (SELECT sum(-adv * logp * least(exp(greatest(-20, least(20, logp - rollout_logp))), 2) * m) AS s, sum(m) AS n FROM tok
    GROUP BY row_id) SELECT round(avg(s), 6) + 0.0 AS loss FROM g WHERE n > 0"""
)
def bypass_loss(spark, sf):
    return _loss(spark, sf, L.bypass_mode, "seq-mean-token-sum")


@query(
    f"""WITH {TOK}, mu AS (SELECT sum(adv * m) / sum(m) AS a, sum(logp * m) / sum(m) AS l, CAST(floor(0.01 * sum(m)) AS BIGINT) AS k
    FROM tok), c AS (SELECT tok.*, row_number() OVER (ORDER BY m DESC, (adv - a) * (logp - l) DESC, row_id, t) <= k AS top FROM tok, mu)
  SELECT round(sum((-adv * {RATIO} + CASE WHEN top THEN abs(greatest(-20, least(20, logp - old_logp))) ELSE 0 END) * m) / sum(m), 5) + 0.0 AS loss
    FROM c"""
)
def kl_cov(spark, sf):
    return L.agg_loss(L.kl_cov(_loss_tokens(spark, sf), share=0.01)).select(r6("loss", 5).alias("loss"))


@query(
    f"""WITH {TOK}, mu AS (SELECT sum(adv * m) / sum(m) AS a, sum(logp * m) / sum(m) AS l, CAST(floor(0.01 * sum(m)) AS BIGINT) AS k
    FROM tok), c AS (SELECT tok.*, k, m = 1 AND (adv - a) * (logp - l) > 1 AND (adv - a) * (logp - l) < 5 AS inside FROM tok, mu),
  o AS (SELECT *, inside AND row_number() OVER (PARTITION BY inside ORDER BY CAST('0x' || substr(md5('0:' || row_id || ':' || t), 1, 8) AS BIGINT),
    row_id, t) <= k AS off FROM c)
  SELECT round(sum(CASE WHEN off THEN 0 ELSE greatest(-adv * {RATIO}, -adv * greatest(0.8, least(1.2, {RATIO}))) * m END) / sum(m), 6) + 0.0 AS loss
    FROM o"""
)
def clip_cov(spark, sf):
    return _loss(spark, sf, L.clip_cov, share=0.01)


def _agg_sql(outer: str) -> str:
    return f"WITH {TOK}, g AS (SELECT sum(v * m) AS s, sum(m) AS n FROM tok GROUP BY row_id) SELECT round({outer}, 6) + 0.0 AS loss FROM g WHERE n > 0"


for _name, _mode, _outer in (
    ("agg_token_mean", "token-mean", "sum(s) / sum(n)"), ("agg_seq_sum", "seq-mean-token-sum", "avg(s)"),
    ("agg_seq_sum_norm", "seq-mean-token-sum-norm", "sum(s) / 64"), ("agg_seq_mean", "seq-mean-token-mean", "avg(s / (n + 1e-8))")
):

    def _agg(spark, sf, mode=_mode):
        return L.agg_loss(_loss_tokens(spark, sf), "v", mode, 64).select(r6("loss").alias("loss"))

    query(_agg_sql(_outer), name=_name)(_agg)


@query(
    f"WITH {TOK} SELECT round(sum(0.5 * greatest((q - v) ** 2, (greatest(v - 0.5, least(v + 0.5, q)) - adv) ** 2) * m) / sum(m), 6) + 0.0 AS loss FROM tok".replace("(q - v) ** 2", "(q - adv) ** 2")
)
def value_loss(spark, sf):
    df = _loss_tokens(spark, sf).withColumns({"vpred": F.col("q"), "value": F.col("v"), "ret": F.col("adv")})
    return L.agg_loss(L.value_loss(df)).select(r6("loss").alias("loss"))


@query(_mean_sql("greatest(-10, least(10, exp(greatest(-20, least(20, ref_logp - logp))) - greatest(-20, least(20, ref_logp - logp)) - 1))"))
def kl_k3(spark, sf):
    return _loss(spark, sf, L.kl_loss)


@query(_mean_sql(f"({VANILLA}) - 0.01 * q + 0.1 * (logp - ref_logp)"))
def ppo_composite(spark, sf):
    df = _loss_tokens(spark, sf).withColumn("entropy", F.col("q"))
    return L.ppo_composite(df, entropy_coef=0.01, kl_coef=0.1, kind="kl").select(r6("loss").alias("loss"))


@query(f"WITH {TOK} SELECT round(-sum(logp * m) / sum(m) * 4, 6) + 0.0 AS loss FROM tok")
def sft_loss(spark, sf):
    return L.sft_loss(_loss_tokens(spark, sf), 4).select(r6("loss").alias("loss"))


_D = "(old_logp - rollout_logp) * m"


def _weights(spark, sf, **k):
    return O.importance_weights(
        rollouts(spark, sf, "old_log_probs", "rollout_log_probs", "response_mask"), **k
    ).select("row_id", r6(M.array_sum("is_weights")).alias("w"))


def _weight_sql(w: str) -> str:
    return f"WITH {TOK}, d AS (SELECT *, sum({_D}) OVER (PARTITION BY row_id) AS s FROM tok), e AS (SELECT row_id, sum({w} * m) AS w FROM d GROUP BY 1) SELECT o_orderkey AS row_id, round(coalesce(w, 0), 6) + 0.0 AS w FROM orders LEFT JOIN e ON row_id = o_orderkey"


@query(_weight_sql(f"least(2, exp({_D}))"))
def is_token(spark, sf):
    return _weights(spark, sf, level="token", threshold=2.0)


@query(_weight_sql("CASE WHEN exp(greatest(-20, least(20, s))) BETWEEN 0.5 AND 2 THEN exp(greatest(-20, least(20, s))) ELSE 0 END"))
def is_seq(spark, sf):
    return _weights(spark, sf, level="sequence", threshold="0.5_2.0")


def _rejected(spark, sf, options, threshold):
    df = rollouts(spark, sf, "old_log_probs", "rollout_log_probs", "response_mask")
    return O.rejection_mask(df, options, threshold).select("row_id", M.mask_count("response_mask").alias("kept"))


def _rs_sql(token: str, row: str) -> str:
    return f"""WITH {TOK}, d AS (SELECT *, {_D} AS d FROM tok), e AS (SELECT row_id, sum(CASE WHEN {token} THEN m ELSE 0 END) AS kept, {row} AS ok FROM d GROUP BY 1)
  SELECT o_orderkey AS row_id, CAST(CASE WHEN ok THEN kept ELSE 0 END AS BIGINT) AS kept FROM orders LEFT JOIN e ON row_id = o_orderkey"""


_K3 = "(exp(greatest(-20, least(20, d))) - 1 - greatest(-20, least(20, d)))"


@query(_rs_sql("true", "exp(greatest(-20, least(20, sum(d) / greatest(1, sum(m))))) BETWEEN 0.5 AND 2"))
def rs_seq_mean_k1(spark, sf):
    return _rejected(spark, sf, ["seq_mean_k1"], 2.0)


@query(_rs_sql("true", "max(0.5 * d * d * m) <= 0.75"))
def rs_seq_max_k2(spark, sf):
    return _rejected(spark, sf, ["seq_max_k2"], 0.75)


@query(_rs_sql("exp(d) BETWEEN 0.4 AND 2.5", "true"))
def rs_token_k1(spark, sf):
    return _rejected(spark, sf, ["token_k1"], "0.4_2.5")


@query(_rs_sql(f"0.5 * d * d <= 0.4 AND {_K3} <= 0.6", f"sum({_K3} * m) <= 1.7 AND sum(0.5 * d * d * m) / greatest(1, sum(m)) <= 0.35"))
def rs_combined(spark, sf):
    return _rejected(spark, sf, ["token_k2", "token_k3", "seq_sum_k3", "seq_mean_k2"], "0.4,0.6,1.7,0.35")


@query(
    f"""WITH {TOK}, g AS (SELECT sum(m) AS n, sum({_D}) AS d, sum(old_logp * m) AS lo, sum(rollout_logp * m) AS lr, sum((exp({_D}) - 1 - {_D}) * m) AS k3,
    sum(exp(2 * {_D}) * m) AS w2 FROM tok GROUP BY row_id HAVING sum(m) > 0), h AS (SELECT *, lo / n AS mo, lr / n AS mr FROM g)
  SELECT round(avg(exp(-mo)), 5) AS training_ppl, round(avg(exp(-mr)), 5) AS rollout_ppl, round(-sum(d) / sum(n), 6) + 0.0 AS kl,
    round(sum(k3) / sum(n), 6) + 0.0 AS k3_kl, round(avg(exp(mr - mo)), 5) AS ppl_ratio, round(max(mr - mo), 6) AS log_ppl_diff_max,
   round(sum(w2) / sum(n) - 1, 5) + 0.0 AS chi2_token FROM h"""
)
def offpolicy(spark, sf):
    m = O.offpolicy_metrics(rollouts(spark, sf, "old_log_probs", "rollout_log_probs", "response_mask"))
    return m.select(
        r6("training_ppl", 5).alias("training_ppl"), r6("rollout_ppl", 5).alias("rollout_ppl"), r6("kl").alias("kl"), r6("k3_kl").alias("k3_kl"),
        r6("ppl_ratio", 5).alias("ppl_ratio"), r6("log_ppl_diff_max").alias("log_ppl_diff_max"), r6("chi2_token", 5).alias("chi2_token")
    )


@query(
    f"""WITH {TOK}, w AS (SELECT least(2, exp({_D})) AS w FROM tok WHERE m = 1)
  SELECT round(avg(w), 6) AS mean, round(max(w), 6) AS max, round(min(w), 6) AS min, round(avg(CASE WHEN w < 0.5 THEN 1.0 ELSE 0 END),
    6) AS share_low, round(avg(w) * avg(w) / avg(w * w), 6) AS ess FROM w"""
)
def is_metrics(spark, sf):
    df = O.importance_weights(rollouts(spark, sf, "old_log_probs", "rollout_log_probs", "response_mask"))
    return O.weight_metrics(df).select(*[r6(c).alias(c) for c in ("mean", "max", "min", "share_low", "ess")])


@query(
    f"""WITH {TOK}, x AS (SELECT exp(old_logp) AS a, exp(rollout_logp) AS b FROM tok WHERE m = 1)
  SELECT round(max(abs(a - b)), 6) AS max, round(avg(abs(a - b)), 6) AS mean, round(stddev_samp(abs(a - b)), 6) AS std, round(corr(a, b),
    5) + 0.0 AS pearson FROM x"""
)
def debug_probs(spark, sf):
    from quillstream.operators.metrics import debug_probabilities

    df = debug_probabilities(rollouts(spark, sf, "old_log_probs", "rollout_log_probs", "response_mask"))
    return df.select(r6("max").alias("max"), r6("mean").alias("mean"), r6("std").alias("std"), r6("pearson", 5).alias("pearson"))


@query(
    """WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), e AS (SELECT vec_id, z, list_max(z) AS mx
    FROM z),
  p AS (SELECT vec_id, z, mx, list_sum(list_transform(z, lambda x: exp(x - mx))) AS s, list_sum(list_transform(z, lambda x: exp(x - mx) * x)) AS zx,
    list_sum(list_transform(z, lambda x: exp(2 * (x - mx)))) AS s2 FROM e)
  SELECT vec_id, round(mx + ln(s) - zx / s, 5) AS entropy, round(s2 / (s * s), 5) AS sum_pi_squared, round(z[1] - mx - ln(s), 5) + 0.0 AS log_prob
    FROM p"""
)
def logits_entropy(spark, sf):
    from quillstream.plans.base import read

    e = read(spark, sf, "embeddings").withColumn("label0", F.lit(0))
    return e.select(
        "vec_id", r6(M.entropy("embedding"), 5).alias("entropy"), r6(M.sum_pi_squared("embedding"), 5).alias("sum_pi_squared"),
        r6(M.log_prob("embedding", "label0"), 5).alias("log_prob")
    )


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings), t AS (SELECT vec_id, i, -CAST(i % 8 AS DOUBLE) - 1 AS p
    FROM x WHERE i < 8), s AS (SELECT vec_id, i, -CAST(i % 5 AS DOUBLE) - 1 AS q FROM x WHERE i BETWEEN 4 AND 11),
  j AS (SELECT t.vec_id, exp(p) * (p - coalesce(q, -5.0)) AS k FROM t LEFT JOIN s ON t.vec_id = s.vec_id AND t.i = s.i)
    SELECT vec_id, round(greatest(0, sum(k)), 6) AS kl FROM j GROUP BY 1"""
)
def topk_kl(spark, sf):
    from quillstream.plans.base import read

    seq = lambda a, b, k: (F.sequence(F.lit(a), F.lit(b)), F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: -(i % k).cast("double") - 1))
    (ti, tp), (si, sp) = seq(0, 7, 8), seq(4, 11, 5)
    e = read(spark, sf, "embeddings").select("vec_id", ti.alias("ti"), tp.alias("tp"), si.alias("si"), sp.alias("sp"))
    return e.select("vec_id", r6(M.topk_forward_kl("ti", "tp", "si", "sp")).alias("kl"))


@query(
    f"""WITH {TOK}, x AS (SELECT m, q AS vpred, greatest(v - 0.5, least(v + 0.5, q)) AS c, adv AS ret FROM tok)
  SELECT round(sum(0.5 * greatest((vpred - ret) ** 2, (c - ret) ** 2) * m) / sum(m), 6) + 0.0 AS loss,
    round(sum(CASE WHEN (c - ret) ** 2 > (vpred - ret) ** 2 THEN m ELSE 0 END) / sum(m), 6) + 0.0 AS clip_fraction, round(sum(vpred * m) / sum(m),
    6) + 0.0 AS value_mean FROM x"""
)
def value_composite(spark, sf):
    df = _loss_tokens(spark, sf).withColumns({"vpred": F.col("q"), "value": F.col("v"), "ret": F.col("adv")})
    return L.value_composite(df).select(*[r6(c).alias(c) for c in ("loss", "clip_fraction", "value_mean")])
