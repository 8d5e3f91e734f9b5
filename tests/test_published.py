"""Labels of the 54 published summaries, derived again from their intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.functions.scores import interpret_interval
from pairwright.study import HARMFUL, HELPFUL, NO_CLEAR

LABELS = {"none": NO_CLEAR, "harmful": HARMFUL, "helpful": HELPFUL}

# Dataset, fraction, model, contrast, interval and label of each summary.
PUBLISHED = [
    ('diabetes', '001pct', 'logistic_regression', 'gaussian_minus_replication', -0.01285268634000325, -0.007053978524852477, 'none'),
    ('diabetes', '001pct', 'logistic_regression', 'replication_minus_real_only', -0.00043960616391317285, 0.0006269428994249747, 'none'),
    ('diabetes', '001pct', 'logistic_regression', 'gaussian_minus_real_only', -0.0125785492508798, -0.00708605891992623, 'none'),
    ('diabetes', '001pct', 'random_forest', 'gaussian_minus_replication', -0.047088340725951514, -0.02584210303337503, 'harmful'),
    ('diabetes', '001pct', 'random_forest', 'replication_minus_real_only', -0.010687221169446969, -0.009698912278142773, 'none'),
    ('diabetes', '001pct', 'random_forest', 'gaussian_minus_real_only', -0.05708104510214157, -0.03602233004025631, 'harmful'),
    ('diabetes', '005pct', 'logistic_regression', 'gaussian_minus_replication', -0.014199179668457724, -0.010100424165560631, 'harmful'),
    ('diabetes', '005pct', 'logistic_regression', 'replication_minus_real_only', -0.00011229803892203636, 5.4542304039444365e-05, 'none'),
    ('diabetes', '005pct', 'logistic_regression', 'gaussian_minus_real_only', -0.014201982110028388, -0.010110675333475396, 'harmful'),
    ('diabetes', '005pct', 'random_forest', 'gaussian_minus_replication', -0.038446071276125864, -0.021151725838166765, 'harmful'),
    ('diabetes', '005pct', 'random_forest', 'replication_minus_real_only', -0.010556114935573395, -0.010078349945190402, 'harmful'),
    ('diabetes', '005pct', 'random_forest', 'gaussian_minus_real_only', -0.048531385252551476, -0.03161941712075871, 'harmful'),
    ('diabetes', '010pct', 'logistic_regression', 'gaussian_minus_replication', -0.010158283465754741, -0.007841975220619316, 'none'),
    ('diabetes', '010pct', 'logistic_regression', 'replication_minus_real_only', -8.080448965240156e-05, -3.5235274564669386e-06, 'none'),
    ('diabetes', '010pct', 'logistic_regression', 'gaussian_minus_real_only', -0.010187383687819532, -0.007857680380153952, 'none'),
    ('diabetes', '010pct', 'random_forest', 'gaussian_minus_replication', -0.035601161144824256, -0.025430152997604188, 'harmful'),
    ('diabetes', '010pct', 'random_forest', 'replication_minus_real_only', -0.010795485623944605, -0.010357567579340329, 'harmful'),
    ('diabetes', '010pct', 'random_forest', 'gaussian_minus_real_only', -0.04643812780441695, -0.03594480336944224, 'harmful'),
    ('diabetes', '025pct', 'logistic_regression', 'gaussian_minus_replication', -0.007724036749569088, -0.005147106263997358, 'none'),
    ('diabetes', '025pct', 'logistic_regression', 'replication_minus_real_only', -3.37512568718761e-05, -1.0918922220559314e-05, 'none'),
    ('diabetes', '025pct', 'logistic_regression', 'gaussian_minus_real_only', -0.007747716614949551, -0.005174042176890684, 'none'),
    ('diabetes', '025pct', 'random_forest', 'gaussian_minus_replication', -0.01950182552149036, -0.012823988491278955, 'harmful'),
    ('diabetes', '025pct', 'random_forest', 'replication_minus_real_only', -0.010672706170733662, -0.010336425982658097, 'harmful'),
    ('diabetes', '025pct', 'random_forest', 'gaussian_minus_real_only', -0.029965323000847335, -0.02328108479611715, 'harmful'),
    ('diabetes', '050pct', 'logistic_regression', 'gaussian_minus_replication', -0.0025572201527265977, -0.0019119043161232162, 'none'),
    ('diabetes', '050pct', 'logistic_regression', 'replication_minus_real_only', -1.3037834082087752e-05, -5.83973106837684e-06, 'none'),
    ('diabetes', '050pct', 'logistic_regression', 'gaussian_minus_real_only', -0.0025543122817358694, -0.0019256459610325783, 'none'),
    ('diabetes', '050pct', 'random_forest', 'gaussian_minus_replication', -0.012891660817038728, -0.009392994010970872, 'none'),
    ('diabetes', '050pct', 'random_forest', 'replication_minus_real_only', -0.007450010841469246, -0.007105472289953673, 'none'),
    ('diabetes', '050pct', 'random_forest', 'gaussian_minus_real_only', -0.02017067675037018, -0.016690179499320286, 'harmful'),
    ('cleveland', '005pct', 'logistic_regression', 'gaussian_minus_replication', -0.11572871572871558, -0.02492739898989888, 'harmful'),
    ('cleveland', '005pct', 'logistic_regression', 'replication_minus_real_only', -0.05212842712842703, -0.01663059163059163, 'harmful'),
    ('cleveland', '005pct', 'logistic_regression', 'gaussian_minus_real_only', -0.14428481240981225, -0.06594471500721498, 'harmful'),
    ('cleveland', '005pct', 'random_forest', 'gaussian_minus_replication', -0.13842126623376624, -0.037210046897546985, 'harmful'),
    ('cleveland', '005pct', 'random_forest', 'replication_minus_real_only', -0.035047348484848556, -0.0125180375180375, 'harmful'),
    ('cleveland', '005pct', 'random_forest', 'gaussian_minus_real_only', -0.15786435786435782, -0.06372610028860026, 'harmful'),
    ('cleveland', '010pct', 'logistic_regression', 'gaussian_minus_replication', -0.091090367965368, -0.030590728715728745, 'harmful'),
    ('cleveland', '010pct', 'logistic_regression', 'replication_minus_real_only', -0.05147997835497833, -0.022799422799422743, 'harmful'),
    ('cleveland', '010pct', 'logistic_regression', 'gaussian_minus_real_only', -0.12673250360750346, -0.0655844155844154, 'harmful'),
    ('cleveland', '010pct', 'random_forest', 'gaussian_minus_replication', -0.09933396464646461, -0.046212121212121135, 'harmful'),
    ('cleveland', '010pct', 'random_forest', 'replication_minus_real_only', -0.018164231601731605, -0.008855519480519524, 'none'),
    ('cleveland', '010pct', 'random_forest', 'gaussian_minus_real_only', -0.11168876262626252, -0.06080447330447328, 'harmful'),
    ('cleveland', '025pct', 'logistic_regression', 'gaussian_minus_replication', -0.037409812409812455, -0.00789953102453104, 'none'),
    ('cleveland', '025pct', 'logistic_regression', 'replication_minus_real_only', -0.017243867243867287, -0.0101010101010102, 'harmful'),
    ('cleveland', '025pct', 'logistic_regression', 'gaussian_minus_real_only', -0.04945977633477639, -0.02333964646464648, 'harmful'),
    ('cleveland', '025pct', 'random_forest', 'gaussian_minus_replication', -0.04529220779220766, -0.01709911616161609, 'harmful'),
    ('cleveland', '025pct', 'random_forest', 'replication_minus_real_only', -0.011760461760461794, -0.0036976911976913177, 'none'),
    ('cleveland', '025pct', 'random_forest', 'gaussian_minus_real_only', -0.052255591630591666, -0.025559163059163132, 'harmful'),
    ('cleveland', '050pct', 'logistic_regression', 'gaussian_minus_replication', -0.0263708513708513, -0.007287157287157334, 'none'),
    ('cleveland', '050pct', 'logistic_regression', 'replication_minus_real_only', -0.0027777777777778273, -0.00018037518037525475, 'none'),
    ('cleveland', '050pct', 'logistic_regression', 'gaussian_minus_real_only', -0.0277417027417028, -0.008658008658008632, 'none'),
    ('cleveland', '050pct', 'random_forest', 'gaussian_minus_replication', -0.02846410533910552, -0.004743867243867456, 'none'),
    ('cleveland', '050pct', 'random_forest', 'replication_minus_real_only', -0.005555555555555614, -0.0005591630591631397, 'none'),
    ('cleveland', '050pct', 'random_forest', 'gaussian_minus_real_only', -0.03093479437229435, -0.008333333333333437, 'none'),
]


def test_published_labels(spark):
    names = "dataset STRING, token STRING, model STRING, contrast STRING, low DOUBLE, high DOUBLE, label STRING"
    rows = spark.createDataFrame(PUBLISHED, names).withColumn(
        "found", interpret_interval(F.col("low"), F.col("high"))
    ).collect()
    assert len(rows) == 54
    assert [r.found for r in rows] == [LABELS[r.label] for r in rows]
    harmful = {}
    for r in rows:
        if r.label == "harmful":
            harmful[r.contrast] = harmful.get(r.contrast, 0) + 1
    assert sorted(harmful.values()) == [7, 10, 12]
