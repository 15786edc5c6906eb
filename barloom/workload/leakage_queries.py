"""L1-L6 on the feature pipeline over hourly bars: every bar is a cut, planted leaks must be caught."""

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.config import N_FEATURES
from barloom.operators import leakage as L
from barloom.operators import tokens as K
from barloom.session import pin
from barloom.workload import views as V
from barloom.workload.registry import query
from barloom.workload.stats_queries import u_sql
from barloom.workload.views import HCFG, HOUR, sql

#: Slices of a day; every replay reads the tape from its first bar, every baseline all of it.
SLICES = L.Slices(24)
_PARTS = ", ".join(f"'{o}'" for o in L.OUTPUTS)
# a clean audit has no failures by definition; the twin counts the comparisons that must have been made
_AUDIT = sql(f"SELECT unnest([{_PARTS}]) AS output, (SELECT count(*) FROM klines) AS n_checks, 0::BIGINT AS n_failures, "
             "(SELECT count(*) FROM klines) AS n_anchors, (SELECT count(*) FROM klines) AS n_bars", "klines")


def tape(spark, sf_dir):
    """Stated bars, ticks and two series of marks: what the feature pipeline is built from."""
    return L.Tape(V.stated(spark, sf_dir), V.trades(spark, sf_dir), V.funding(spark, sf_dir), V.open_interest(spark, sf_dir)).pinned()


@query("truncation_sweep", _AUDIT)
def truncation_sweep(spark, sf_dir):
    return L.assert_covered(L.audit(tape(spark, sf_dir), HCFG, SLICES))


for _mode in ("noise", "revert", "signflip"):
    @query(f"perturbation_probe_{_mode}", _AUDIT)
    def _probe(spark, sf_dir, mode=_mode):
        return L.assert_covered(L.audit(tape(spark, sf_dir), HCFG, SLICES, mode=mode))


def leak_bar(t):
    """A bar in the middle of the tape whose slice is past the warm-up: the last but two of its day."""
    lo, hi = t.klines.agg(F.min("bar_open_ms"), F.max("bar_open_ms")).first()
    return ((lo + hi) // 2 // HOUR // SLICES.length * SLICES.length + SLICES.length - 3) * HOUR


def planted(t):
    at = leak_bar(t)
    return {"centered_zscore": None, "global_zscore": None, "sigma_next": None, "forward_revert": None, "validity_next": at}


_CAUGHT = ("centered_zscore", "global_zscore", "sigma_next", "forward_revert", "validity_next")


@query("planted_leaks", f"SELECT unnest([{', '.join(repr(k) for k in _CAUGHT)}]) AS leak, true AS caught")
def planted_leaks(spark, sf_dir):
    t = tape(spark, sf_dir)
    return L.caught_leaks(t, HCFG, SLICES, planted(t)).select("leak", (F.col("n_failures") > 0).alias("caught"))


_ARM = ("slice_exceeds_warm_up", "valid_targets", "clean_passes", "all_anchors_met", "sigma_next_inside", "caught_sigma_next")


@query("audit_control_arm", f"SELECT unnest([{', '.join(repr(k) for k in _ARM)}]) AS check, true AS holds, true AS valid")
def audit_control_arm(spark, sf_dir):
    t = tape(spark, sf_dir)
    return L.control_arm(t, HCFG, SLICES, {"sigma_next": leak_bar(t)}).select("check", "holds", "valid")


def _near(flag):
    return f"max(({flag})::INT) OVER (PARTITION BY symbol ORDER BY bar_open_ms ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1"


@query("anchor_strata", sql(
    f"""SELECT symbol, bar_open_ms, stratum FROM (SELECT *, row_number() OVER (PARTITION BY symbol, e.stratum ORDER BY e.must DESC, {u_sql("'2:' || symbol || ':' || e.stratum || ':' || row_idx")}, symbol, row_idx) AS r, e.stratum AS stratum FROM
 (SELECT symbol, bar_open_ms, row_idx, unnest(list_filter([CASE WHEN {_near('seg_pos = 0')} THEN {{'stratum': 'segment_start', 'must': (seg_pos = 0)::INT}} END,
  CASE WHEN {_near('n_trades <= 3')} THEN {{'stratum': 'stale', 'must': (n_trades <= 3)::INT}} END, {{'stratum': 'background', 'must': 0}}], lambda x: x IS NOT NULL)) AS e
 FROM panel)) WHERE r <= 12""", "panel"))
def anchor_strata(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir).select("symbol", "bar_open_ms", "row_idx", "seg_pos", "is_stale"))
    out = L.anchor_strata(p, {"segment_start": F.col("seg_pos") == 0, "stale": F.col("is_stale") == 1}, 12, 2, block=64)
    return out.select("symbol", "bar_open_ms", "stratum")


def _tokens(df):
    """Codes of all features; one that is no number has none and hides no other."""
    return df.withColumn("token", K.fsq_codes(F.array(*[f"x_{d}" for d in range(N_FEATURES)]), [K.FSQ_LEVELS[0]] * N_FEATURES))


def _noons(t):
    """The middle bar of every day that has it."""
    return t.klines.filter(F.floor(F.col("bar_open_ms") / HOUR) % SLICES.length == 12)


_EARLIER = sql(f"SELECT count(*) AS n FROM klines k JOIN klines c ON k.symbol = c.symbol AND k.bar_open_ms // {24 * HOUR} = c.bar_open_ms // {24 * HOUR} "
               f"AND k.bar_open_ms <= c.bar_open_ms WHERE c.bar_open_ms // {HOUR} % 24 = 12", "klines")


@query("token_causality_probe", _EARLIER.replace("count(*) AS n", "count(*) AS n, 0::BIGINT AS n_flips"))
def token_causality_probe(spark, sf_dir):
    t = tape(spark, sf_dir)
    return L.token_flips(t, HCFG, SLICES, _tokens, _noons(t))


@query("token_causality_planted", _EARLIER.replace("count(*) AS n", "count(*) AS n, true AS caught"))
def token_causality_planted(spark, sf_dir):
    t = tape(spark, sf_dir)
    return L.token_flips(t, replace(HCFG, leak="centered_zscore"), SLICES, _tokens, _noons(t)).select("n", (F.col("n_flips") > 0).alias("caught"))
