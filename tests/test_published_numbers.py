"""Published tables recomputed from the published inputs they follow from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.operators import fits, forms, resample

# Size bins of one session and their impact over daily volatility.
BINS = [
    (4.247490804871684e-07, 0.0028932212407723696), (1.6729197637696464e-06, 0.0031221721800426833),
    (3.463558218741862e-06, 0.00442331121930162), (6.1712430020624045e-06, 0.005563718982581299),
    (1.0725630510914476e-05, 0.005759316916075509), (1.7057403412609364e-05, 0.005143234942343496),
    (2.210584098385343e-05, 0.00845196615606202), (3.11850787478082e-05, 0.009680978996621252),
    (4.301109910274624e-05, 0.01221605533145042), (6.154389107852369e-05, 0.014672003364624292),
    (9.530513244668433e-05, 0.018621039700233894), (0.0002570097508712462, 0.025803303121441582),
]
# Test over training volatility of 15 sessions, and the square-root model's slope there.
SHIFT = [
    (0.6200224836916542, 0.5152919596734434), (0.5964180004834811, 0.500954240582653), (0.5752026910092608, 0.5194560911294898),
    (0.632754545665169, 0.584208631224194), (0.6342428055748924, 0.5362182011973835), (0.5059780978192904, 0.47888991217866134),
    (0.6222141271336148, 0.5343516556692685), (0.6523501875997323, 0.48450709160819516), (0.6816846320168495, 0.3839152400141141),
    (1.011714333614639, 0.712724907070436), (0.6330049361755226, 0.5027704755566377), (0.6407195634048812, 0.5085893281277826),
    (0.6090588626766972, 0.8127282370912462), (1.0843267959401288, 0.9859364141376099), (0.6308637801422416, 0.7174126201311202),
]
# Explanatory R2 and size exponents of one symbol's five sessions.
R2 = [0.3087892793380126, 0.4071479792944258, 0.38415431620752294, 0.43732219386406934, 0.3156196784399736]
EXPONENTS = [0.28552647997633723, 0.30370841685544764, 0.39550472252979074, 0.3152354000442579, 0.48726714009420513]


def test_size_exponent(spark):
    r = fits.log_log(spark.createDataFrame(BINS, "q double, y double"), "q", "y").first()
    assert r.exponent == pytest.approx(0.37044105031774394, abs=1e-9) and r.n == 12


def test_volatility_shift_against_slope(spark):
    d = spark.createDataFrame(SHIFT, "ratio double, slope double")
    r = d.agg(F.median("ratio").alias("m"), F.median("slope").alias("s"), F.corr("ratio", "slope").alias("c")).first()
    assert (r.m, r.s) == (0.632754545665169, 0.5194560911294898)
    assert r.c == pytest.approx(0.6782509389502913, abs=1e-12)
    assert fits.spearman(d, "ratio", "slope").first().rho == pytest.approx(0.16785714285714282, abs=1e-12)


def test_bootstrap_bands():
    assert np.mean(R2) == pytest.approx(0.3706066894288008)
    assert resample.band(R2) == pytest.approx((0.3265944463526991, 0.41461893250490267), abs=1e-9)
    assert resample.band(EXPONENTS) == pytest.approx((0.29874103874156555, 0.43220291193357074), abs=1e-9)


def test_information_criterion():
    assert forms.information(600, 23452345.454796206, 3) == pytest.approx(6350.1308472198625, abs=1e-6)


def test_crossover_in_ticks(spark):
    d = spark.createDataFrame([(5064.383532933176, 8.738431283684778e-08)], "a double, q double")
    r = d.select(X.crossover_ticks(F.col("a"), F.col("q"), F.lit(0.0011493636542202995 / 0.000442547674967613), F.lit(1.0)).alias("x")).first().x
    assert r.impact_sigma == pytest.approx(0.000442547674967613, rel=1e-12)
    assert r.impact_ticks == pytest.approx(0.11493636542202995, rel=1e-12) and not r.above_one_tick
    two = spark.createDataFrame([(2.0, 0.01)], "a double, q double").select(X.crossover_ticks(F.col("a"), F.col("q"), F.lit(0.01), F.lit(100.0)).alias("x")).first().x
    assert (two.impact_money, two.impact_ticks) == (pytest.approx(0.02), pytest.approx(2.0))
