"""The adjusted rank test against brute force over all genes."""

import math

import numpy as np

from tensorloom.plans import demo_data as D
from tensorloom.plans.catalog import queries
from tests.conftest import DATA


def test_rank_genes_adjusted_counts_every_gene(spark):
    groups = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    long = D.counts(spark, DATA).groupBy("cell", "gene").agg({"value": "sum"}).toPandas()
    wide = long.pivot(index="cell", columns="gene", values="sum(value)").reindex(sorted(groups)).fillna(0.0)
    ranks, lang = wide.rank(), np.array([groups[c] for c in wide.index])
    n = len(wide)
    ties = {g: sum(t**3 - t for t in wide[g].value_counts()) for g in wide.columns}
    want = {}
    for grp in set(lang):
        n1 = int((lang == grp).sum())
        sums, p = ranks[lang == grp].sum(), {}
        for g in wide.columns:
            var = n1 * (n - n1) / 12 * ((n + 1) - ties[g] / (n * (n - 1)))
            if var > 0:
                p[g] = math.erfc(abs(sums[g] - n1 * (n + 1) / 2) / math.sqrt(var) / math.sqrt(2))
        least = 1.0
        for k, g in reversed(list(enumerate(sorted(p, key=p.get), 1))):
            least = min(least, p[g] * len(p) / k)
            if least < 0.05:
                want[g, grp] = least
    got = {(r.gene, r.grp): r.p_adjusted for r in queries()["rank_genes_adjusted"](spark, DATA).collect()}
    assert got.keys() == want.keys() and len({g for g, _ in got}) > 9
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-12) for k in want)
