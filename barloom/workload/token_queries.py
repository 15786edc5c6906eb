"""Q1-Q9, A11-A13, T11-T14 on embeddings and the weekly panel."""

from pyspark.sql import functions as F

from barloom.operators import segments as S
from barloom.operators import tokens as K
from barloom.session import pin
from barloom.workload import eval_queries as Q
from barloom.workload import views as V
from barloom.workload.registry import query
from barloom.workload.stats_queries import u_sql
from barloom.workload.views import WCFG, cte, rd, rq, sql

TL = S.timeline(WCFG)
LV = K.FSQ_LEVELS
C, Fi = K.coarse_fine(LV)


def _code(z, n):
    return f"(round_even({(n - 1) / 2} * tanh({z}), 0) + {(n - 1) // 2})::INT"


def _flat(codes, group):
    out = "0"
    for i in group:
        out = f"({out} * {LV[i]} + {codes}[{i + 1}])"
    return f"{out}::BIGINT"


cte("codes", "SELECT vec_id, [" + ", ".join(_code(f"embedding[{i + 1}]::DOUBLE", n) for i, n in enumerate(LV)) + "] AS codes FROM embeddings")
cte("etok", f"SELECT vec_id, codes, {_flat('codes', C)} AS b_c, {_flat('codes', Fi)} AS b_f FROM codes", "codes")


def latents(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def coded(spark, sf_dir):
    return latents(spark, sf_dir).withColumn("codes", K.fsq_codes(F.col("embedding"))).withColumns(
        {"b_c": K.flatten_codes(F.col("codes"), C, LV), "b_f": K.flatten_codes(F.col("codes"), Fi, LV)})


def _join(arr):
    return F.array_join(F.transform(arr, lambda v: v.cast("string")), ",")


@query("fsq_quantize", sql("SELECT vec_id, array_to_string(codes, ',') AS codes FROM codes", "codes"))
def fsq_quantize(spark, sf_dir):
    return coded(spark, sf_dir).select("vec_id", _join("codes").alias("codes"))


@query("bsq_quantize", f"""SELECT vec_id, array_to_string([(v >= 0)::INT FOR v IN embedding[1:20]], '') AS bits, {rq('''list_sum([pow(v::DOUBLE / sqrt(list_sum([w::DOUBLE * w::DOUBLE
 FOR w IN embedding[1:20]])) - (CASE WHEN v >= 0 THEN 1.0 ELSE -1.0 END) / sqrt(20), 2) FOR v IN embedding[1:20]]) / 20''')} AS commitment FROM embeddings""")
def bsq_quantize(spark, sf_dir):
    z = F.slice("embedding", 1, 20)
    return latents(spark, sf_dir).select("vec_id", F.array_join(F.transform(K.bsq_codes(z), lambda b: b.cast("string")), "").alias("bits"),
                                         rd(K.bsq_commitment(z)).alias("commitment"))


@query("flatten_codes", sql("SELECT vec_id, b_c, b_f FROM etok", "etok"))
def flatten_codes(spark, sf_dir):
    return coded(spark, sf_dir).select("vec_id", "b_c", "b_f")


@query("unflatten_codes", sql(
    "SELECT vec_id, array_to_string([" + ", ".join(f"(codes[{i + 1}] - {(n - 1) // 2})::INT" for i, n in enumerate(LV)) + "], ',') AS grid FROM etok", "etok"))
def unflatten_codes(spark, sf_dir):
    t = coded(spark, sf_dir).select("vec_id", "b_c", "b_f")
    both = F.concat(K.unflatten_codes(F.col("b_c"), C, LV), K.unflatten_codes(F.col("b_f"), Fi, LV))
    return t.select("vec_id", _join(F.transform(K.fsq_values(both), lambda v: v.cast("int"))).alias("grid"))


@query("coarse_only", sql(
    "SELECT vec_id, " + " + ".join(f"abs(codes[{i + 1}] - {(LV[i] - 1) // 2})" for i in C) + " AS total, 0::BIGINT AS fine FROM etok", "etok"))
def coarse_only(spark, sf_dir):
    v = K.coarse_only(K.fsq_values(F.col("codes")), Fi)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    return coded(spark, sf_dir).withColumn("v", v).select("vec_id", total(F.col("v")).cast("int").alias("total"),
                                                          total(F.slice("v", len(C) + 1, len(Fi))).cast("bigint").alias("fine"))


@query("digit_onehots", sql(
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE codes[{i + 1}] = {v}) AS d{i}_{v}" for i, n in enumerate(LV) for v in range(n)) + " FROM etok", "etok"))
def digit_onehots(spark, sf_dir):
    x = K.digit_onehots(coded(spark, sf_dir).select("b_c", "b_f"))
    return x.agg(*[F.sum(f"d{i}_{v}").alias(f"d{i}_{v}") for i, n in enumerate(LV) for v in range(n)])


_LOG = " + ".join(f"log2({n})" for n in LV)


@query("codebook_parity", f"""SELECT layout, count(*) AS n_vectors, {rq('any_value(bits)')} AS bits, any_value(v_c)::INT AS v_c, any_value(v_f)::INT AS v_f FROM embeddings,
 (SELECT 'fsq' AS layout, {_LOG} AS bits, 891 AS v_c, 1225 AS v_f UNION ALL SELECT 'bsq', 20, 1024, 1024) GROUP BY 1""")
def codebook_parity(spark, sf_dir):
    """Code book sizes next to the number of vectors coded with them."""
    layouts = K.layout_table(spark, {"fsq": LV, "bsq": [2] * 20})
    assert K.parity_check(layouts, "fsq", "bsq").first()["passes"]
    n = latents(spark, sf_dir).withColumn("layout", F.explode(F.array(F.lit("fsq"), F.lit("bsq")))).groupBy("layout").agg(F.count("*").alias("n_vectors"))
    return n.join(layouts, "layout").select("layout", "n_vectors", rd("bits").alias("bits"), "v_c", "v_f")


def _usage(tok, vocab, leg):
    return f"""SELECT '{leg}' AS leg, sum(n)::BIGINT AS n_tokens, count(*) AS n_used, {rq(f'count(*) / {vocab}')} AS utilization, {rq('-sum(n / t * log2(n / t))')} AS entropy_bits,
 {rq('pow(2, -sum(n / t * log2(n / t)))', 4)} AS perplexity, {vocab} - count(*) AS dead_codes FROM (SELECT {tok}, count(*) AS n, sum(count(*)) OVER () AS t FROM etok GROUP BY 1)"""


@query("codebook_usage", sql(_usage("b_c", 891, "coarse") + " UNION ALL " + _usage("b_f", 1225, "fine"), "etok"))
def codebook_usage(spark, sf_dir):
    t = pin(coded(spark, sf_dir).select("b_c", "b_f"))
    cols = ["leg", "n_tokens", "n_used", rd("utilization").alias("utilization"), rd("entropy_bits").alias("entropy_bits"), rd("perplexity", 4).alias("perplexity"), "dead_codes"]
    parts = [K.codebook_usage(t, [], c, v).withColumn("leg", F.lit(n)).select(*cols) for c, v, n in (("b_c", 891, "coarse"), ("b_f", 1225, "fine"))]
    return parts[0].unionByName(parts[1])


# tokens of the panel from its first seven features
cte("ptok", "SELECT *, " + _flat("codes", C) + " AS b_c, " + _flat("codes", Fi) + " AS b_f FROM (SELECT *, [" + ", ".join(
    _code(f"round(x_{i}, 9)", n) for i, n in enumerate(LV)) + "] AS codes, row_idx < 0.8 * count(*) OVER (PARTITION BY symbol) AS is_train FROM panel)", "panel")


def panel_tokens(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir))
    n = p.groupBy("symbol").agg(F.count("*").alias("_n"))
    p = p.join(n, "symbol").withColumn("is_train", F.col("row_idx") < F.col("_n") * 0.8).drop("_n")
    p = p.withColumn("codes", K.fsq_codes(F.array(*[F.round(f"x_{i}", 9) for i in range(7)])))
    return p.withColumns({"b_c": K.flatten_codes(F.col("codes"), C, LV), "b_f": K.flatten_codes(F.col("codes"), Fi, LV)})


@query("marginal_ce_acc", sql(
    f"""SELECT {rq('-sum(v * ln((coalesce(c, 0) + 1.0) / ((SELECT count(*) FROM ptok WHERE is_train) + 891.0))) / sum(v)')} AS ce, {rq('sum(v) FILTER (WHERE b_c = (SELECT b_c FROM ptok WHERE is_train GROUP BY 1 ORDER BY count(*) DESC, b_c LIMIT 1)) / sum(v)')}
 AS accuracy FROM (SELECT b_c, count(*) AS v FROM ptok WHERE NOT is_train GROUP BY 1) a LEFT JOIN (SELECT b_c, count(*) AS c FROM ptok WHERE is_train GROUP BY 1) b USING (b_c)""", "ptok"))
def marginal_ce_acc(spark, sf_dir):
    t = pin(panel_tokens(spark, sf_dir).select("b_c", "is_train"))
    out = K.marginal_ce_acc(t.filter("is_train"), t.filter("not is_train"), "b_c", 891)
    return out.select(rd("ce").alias("ce"), rd("accuracy").alias("accuracy"))


@query("mutual_information", sql(
    f"""SELECT symbol, {rq('sum(n / t * ln(n * t / (na * nb)))')} AS mi FROM (SELECT symbol, a, b, n, sum(n) OVER (PARTITION BY symbol) AS t, sum(n) OVER (PARTITION BY symbol, a) AS na,
 sum(n) OVER (PARTITION BY symbol, b) AS nb FROM (SELECT symbol, codes[1] AS a, codes[6] AS b, count(*) AS n FROM ptok GROUP BY 1, 2, 3)) GROUP BY 1""", "ptok"))
def mutual_information(spark, sf_dir):
    t = pin(panel_tokens(spark, sf_dir).select("symbol", F.col("codes")[0].alias("a"), F.col("codes")[5].alias("b")))
    return K.mutual_information(t, ["symbol"], "a", "b").withColumn("mi", rd("mi"))


_CH = K.noisy_map(LV[1], LV[2], 1.3)
_CHROWS = ", ".join(f"({s}, {v}, {p!r}::DOUBLE)" for s, row in enumerate(_CH) for v, p in enumerate(row))


cte("ch", f"SELECT * FROM (VALUES {_CHROWS}) t(s, v, d)")
cte("src", "SELECT codes[2] AS s, count(*) / (SELECT count(*) FROM ptok) AS p FROM ptok GROUP BY 1", "ptok")
cte("outm", "SELECT v, sum(p * d) AS m FROM ch JOIN src USING (s) GROUP BY 1", "ch", "src")


@query("channel_info", sql(
    f"""SELECT {rq('(SELECT sum(p * d * ln(d / m)) FROM ch JOIN src USING (s) JOIN outm USING (v) WHERE d > 0)')} AS info, {rq('sum(CASE WHEN m > 0 THEN m * ln(m / q) ELSE 0 END)')} AS kl,
 {rq('sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) - sum(CASE WHEN m > 0 THEN m * ln(m) ELSE 0 END)')} AS entropy_shift FROM outm FULL JOIN (SELECT codes[3] AS v, count(*) / (SELECT count(*) FROM ptok)
 AS q FROM ptok GROUP BY 1) c USING (v)""", "outm", "src", "ch", "ptok"))
def channel_info(spark, sf_dir):
    t = pin(panel_tokens(spark, sf_dir).select(F.col("codes")[1].alias("s"), F.col("codes")[2].alias("v")))
    out = K.channel_info(t, "s", _CH, t, "v")
    return out.select(rd("info").alias("info"), rd("kl").alias("kl"), rd("entropy_shift").alias("entropy_shift"))


def _cdf_sql(u, s):
    rows = []
    for row in _CH:
        run, acc = [], 0.0
        for v in row:
            acc += v
            run.append(repr(acc))
        rows.append("[" + ", ".join(f"{r}::DOUBLE" for r in run) + "]")
    return f"least(len(list_filter([{', '.join(rows)}][{s} + 1], lambda c: c <= {u})), {len(_CH[0]) - 1})"


@query("noisy_plant", sql(
    f"""SELECT symbol, bar_open_ms, CASE WHEN s IS NULL THEN codes[3] ELSE {_cdf_sql('u', 's')} END::INT AS planted FROM (SELECT *, {u_sql("'8:' || symbol || ':' || bar_open_ms")} AS u,
 lag(codes[2], 2) OVER (PARTITION BY symbol, segment_id ORDER BY bar_open_ms) AS s FROM ptok)""", "ptok"))
def noisy_plant(spark, sf_dir):
    t = panel_tokens(spark, sf_dir).select("symbol", "bar_open_ms", "segment_id", F.col("codes")[1].alias("s"), F.col("codes")[2].alias("v"))
    return K.noisy_plant(t, TL, "s", "v", _CH, 8).select("symbol", "bar_open_ms", "planted")


@query("legibility_gate")
def legibility_gate(spark, sf_dir):
    return K.legibility_gate(panel_tokens(spark, sf_dir), range(7, 13), least=1000)


@query("window_context_probe")
def window_context_probe(spark, sf_dir):
    return K.window_context_probe(panel_tokens(spark, sf_dir), TL, 7, [1, 2])


@query("discriminative_score")
def discriminative_score(spark, sf_dir):
    from barloom.operators.samples import block_time_permute
    p = pin(V.panel(spark, sf_dir).withColumn("id", F.concat_ws(":", "symbol", "bar_open_ms")))
    cols = [f"x_{d}" for d in range(13)]
    score = K.discriminative_score(p, block_time_permute(p, 17), cols)
    return p.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("score", F.lit(score))


@query("tstr_trtr")
def tstr_trtr(spark, sf_dir):
    from barloom.operators.samples import block_time_permute
    from barloom.operators.windows import forward_returns
    y = pin(forward_returns(V.panel(spark, sf_dir), TL, 4))
    cols = [f"x_{d}" for d in range(13)]
    test = y.filter("y is not null and row_idx >= 250")
    train = y.filter("row_idx < 250")
    return K.tstr_trtr(train.filter("y is not null"), block_time_permute(train, 17).filter("y is not null"), test, cols, "y")
