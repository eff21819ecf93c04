import datetime
import unicodedata
from hashlib import md5 as stats_md5

import pytest
from pyspark.sql import functions as F

from spendlake.functions import stats, tables, text
from spendlake.operators import cleaning, comparison, joins, models, pricing, quality, resampling, spend, star
from spendlake.sources import files
from spendlake.streaming import ingest
from tests import compare


def one(df):
    return df.collect()[0].asDict()


def test_parse_unit(spark):
    df = spark.createDataFrame([("EMBALAGEM 500,00 G",), ("CAIXA 1,00 L",), ("QUILOGRAMA",), (" unidade ",), ("XYZ",), (None,)], "u string")
    dim, value = text.parse_unit(F.col("u"))
    assert [tuple(r) for r in df.select(dim, value).collect()] == [("PESO", 500.0), ("VOLUME", 1000.0), ("PESO", 1000.0), ("CONTAGEM", None), (None, None), (None, None)]


def test_accents_of_all_characters(spark):
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    every = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x30000)) if c % 3 == 0 or plain(chr(c)) != chr(c)]
    rows = ["".join(every[k : k + 50]) for k in range(0, len(every), 50)] + ["Papéis ﬁnos Ångström ½ 한국어 ｶﾞ", "", None]
    got = spark.createDataFrame([(t,) for t in rows], "t string").repartition(4).select("t", text.strip_accents(F.col("t")).alias("p")).collect()
    assert len(got) == len(rows) and all(r.p == (None if r.t is None else plain(r.t)) for r in got)


def test_item_key_and_booleans(spark):
    df = spark.createDataFrame([("  Papél   A4 ",), ("papel a4",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(text.item_key(F.col("x"))).collect()] == ["papel a4", "papel a4", None, None]
    df = spark.createDataFrame([("True",), ("1",), ("no",), (None,)], "x string")
    assert [r[0] for r in df.select(text.to_boolean(F.col("x"))).collect()] == [True, True, False, False]


def test_unit_comparability(spark):
    df = spark.createDataFrame([("a", "GRAMA"), ("a", "QUILOGRAMA"), ("a", "X 500,00 G"), ("b", "QUILOGRAMA"), ("b", "UNIDADE"), ("c", "UNIDADE"), ("d", None), (None, "G")], "i string, u string")
    assert dict(cleaning.unit_comparability(df, "i", "u").collect()) == {"a": "unit_requires_conversion", "b": "unit_unknown", "c": "unit_comparable", "d": "unit_comparable"}


def test_revisions_keep_the_newest_and_same_date_pairs(spark):
    day = datetime.date
    df = spark.createDataFrame([("k", day(2025, 1, 1), 10.0), ("k", day(2025, 1, 5), 12.0), ("s", day(2025, 1, 1), 1.0), ("s", day(2025, 1, 1), 2.0), (None, day(2025, 1, 1), 3.0), (None, day(2025, 1, 2), 4.0)], "k string, d date, v double")
    assert sorted(r.v for r in cleaning.resolve_revisions(df, ["k"], "d").collect()) == [1.0, 2.0, 3.0, 4.0, 12.0]
    flagged = cleaning.flag_conflicts(df, "k", "d", "v")
    assert sorted(r.v for r in flagged.filter("conflict").collect()) == [1.0, 2.0]


def test_outliers(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 2, 1, 2, 3, 2, 1, 2)] + [("a", 6264000.0), ("b", 1.0), ("b", 1e9)]
    out = star.flag_value_outliers(spark.createDataFrame(rows, "item_key string, quantity double"), "item_key", ["quantity"])
    assert [tuple(r) for r in out.filter("is_outlier").select("quantity", "reason").collect()] == [(6264000.0, "quantity")]
    assert out.filter("item_key = 'b' and z_quantity is not null").count() == 0


def test_hhi_and_abc(spark):
    df = spark.createDataFrame([("x", "s1", "i", 10.0), ("y", "s1", "i", 5.0), ("y", "s2", "i", 5.0)], "category string, supplier_key string, item_key string, total_price double")
    got = {r.category: (r.hhi, r.level) for r in spend.hhi(df).collect()}
    assert got == {"x": (10000.0, "altamente concentrado"), "y": (5000.0, "altamente concentrado")}
    assert spend.hhi(df.limit(0)).count() == 0
    assert [r.abc for r in spend.abc_curve(df).filter("category = 'y'").orderBy("rank").collect()] == ["A", "C"]


def test_quality(spark):
    df = spark.createDataFrame([(1, 10.0), (1, -5.0), (2, 0.0), (3, None)], "k int, v double")
    assert one(quality.key_duplicates(df, "k"))["duplicates"] == 1
    assert one(quality.value_range(df, "v")) == {"below": 1, "zero": 1, "missing": 1, "below_pct": 25.0, "zero_pct": 25.0}
    assert {(r.column, r.status, r.filled) for r in quality.schema_drift(df, ["k", "c"]).collect()} == {("k", "expected", df.filter("k is not null").count()), ("v", "new", df.filter("v is not null").count()), ("c", "missing", None)}
    assert quality.null_profile(df.limit(0)).collect()[0].pct is None


def test_baseline_and_bootstrap(spark):
    base = spark.createDataFrame([("n", 1.0), ("n", 2.0), ("n", 3.0), ("n", 4.0), ("m", 1.0)], "item_key string, unit_price double")
    got = {r.item_key: (r.expected, r.reliable) for r in pricing.median_baseline(base, 2).collect()}
    assert got == {"n": (2.5, True), "m": (1.0, False)}
    pairs = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "item_key string, delta double")
    assert one(resampling.clustered_bootstrap(pairs, "item_key", "delta", 50)) == {"delta": 1.0, "low": 1.0, "high": 1.0, "verdict": "reference_better"}
    assert one(resampling.clustered_bootstrap(pairs.withColumn("delta", F.lit(0.0)), "item_key", "delta", 50))["verdict"] == "inconclusive"


def test_resamples_draw_as_many_clusters_as_there_are(spark):
    rows = [(f"c{k % 300}" if k % 7 else None, float(k % 11) - 5) for k in range(3000)]
    pairs = spark.createDataFrame(rows, "item_key string, delta double")
    got = resampling.resampled(pairs, "item_key", "delta", 200, leaf=16).toPandas().sort_values("b")
    n = len({c for c, _ in rows})
    assert len(got) == 200 and (got.n == n).all()
    con = compare.duckdb.connect()
    con.register("p", pairs.toPandas())
    want = con.execute("WITH RECURSIVE " + resampling.resampled_sql("p", 200, 42, 16) + " SELECT * FROM m ORDER BY b").df()
    assert (want.n == n).all() and abs(want.m.values - (got.s / got.c).values).max() < 1e-12
    # moments of a multinomial mean: each cluster is drawn once on average, with variance 1 - 1 / n
    sizes = resampling.np.bincount([int(c[1:]) if c else 300 for c, _ in rows])
    assert abs(got.c.mean() - 3000) < 4 * resampling.np.sqrt(n * sizes.var() / 200)
    assert resampling.resampled(pairs.limit(0), "item_key", "delta", 5).count() == 0
    none = one(resampling.clustered_bootstrap(pairs.limit(0), "item_key", "delta", 5))
    assert none["delta"] is None and none["low"] is None and none["verdict"] == "inconclusive"


def test_draws_of_leaves_are_whole_and_even():
    sizes = resampling.np.array([3, 0, 5, 8, 0, 0, 1, 7])
    got = resampling.np.stack([resampling.dealt(sizes, 42, b) for b in range(2000)])
    assert (got.sum(axis=1) == 24).all() and (got[:, sizes == 0] == 0).all()
    spread = resampling.np.sqrt(24 * sizes / 24 * (1 - sizes / 24) / 2000)
    assert (abs(got.mean(axis=0) - sizes) <= 4 * spread + 1e-9).all()


def test_savings_priority(spark):
    df = spark.createDataFrame([("a", 60.0), ("b", 20.0), ("c", 10.0), ("d", 10.0)], "id string, saving double")
    assert [r.priority for r in pricing.savings_priority(df, "id").orderBy("id").collect()] == ["Alta", "Alta", "Media", "Baixa"]
    assert pricing.savings_priority(df.limit(0), "id").count() == 0


def test_running_sum_over_many_wide_partitions(spark):
    wide = spark.range(200_000).select((F.col("id") % 1000).alias("v"), "id", *(F.sha2(F.concat("id", F.lit(k)), 256).alias(f"w{k}") for k in range(3)))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        out = tables.running(wide, {"before": F.col("v"), "rank": F.lit(1)}, [F.desc("v"), F.col("id")]).select("v", "id", "before", "rank").toPandas()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    out = out.sort_values(["v", "id"], ascending=[False, True])
    assert len(out) == 200_000 and (out["before"].to_numpy() == out.v.cumsum().to_numpy() - out.v.to_numpy()).all() and (out["rank"].to_numpy() == range(200_000)).all()
    by = tables.running(spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 7)], "k string, v int"), {"s": F.col("v")}, [F.col("v")], ["k"])
    assert sorted(((r.k or "", r.v, r.s) for r in by.collect())) == [("", 5, 0), ("", 7, 5), ("a", 1, 0), ("a", 2, 1)]


def test_quantile_in_passes(spark, monkeypatch):
    monkeypatch.setattr(tables, "FEW", 200)
    monkeypatch.setattr(tables, "RANGES", 64)
    df = spark.range(5001).select(F.when(F.col("id") < 2000, 0.0).otherwise(F.pow(F.col("id") % 977, F.lit(2))).alias("x"))
    for level in (0.3, 0.95):
        assert abs(tables.quantile(df, "x", level, "q").first()[0] - df.agg(F.percentile("x", level)).first()[0]) < 1e-6
    assert tables.quantile(df.limit(0), "x", 0.5, "q").first()[0] is None


@pytest.mark.parametrize("few", [60, 10_000])
def test_quantiles_of_groups_in_passes(spark, monkeypatch, few):
    monkeypatch.setattr(tables, "FEW", few)
    monkeypatch.setattr(tables, "RANGES", 64)
    k = F.col("id")
    x = F.when(k % 97 == 0, None).when(k % 89 == 0, float("nan")).when(k % 3 == 0, 5.0).otherwise(F.exp((k * 7919 % 1000) / 40.0))
    group = F.when(k % 10 < 7, "hot").when(k % 10 == 7, "b").when(k < 60, "few")  # the others have none
    df = spark.range(3000).select(group.alias("g"), (k % 2).alias("h"), x.alias("x"))
    df = df.unionByName(spark.createDataFrame([("inf", 0, float(v)) for v in ("inf", "-inf", "1", "2", "inf", "3", "3")] * 10 + [("flat", 1, 4.0)] * 70 + [("none", 1, None)], df.schema))
    levels = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    own = df.filter("x is not null and not isnan(x)")
    for by in (["g", "h"], []):
        want = own.groupBy(*by).agg(*(F.percentile("x", q).alias(n) for n, q in levels.items()))
        got, want = ({tuple(r[c] for c in by): [r[n] for n in levels] for r in d.collect()} for d in (tables.quantiles(df, "x", levels, by), want))
        assert got.keys() == want.keys()
        for key in got:
            assert got[key] == pytest.approx(want[key], rel=1e-12, nan_ok=True), key


def test_metrics_are_not_made_of_nothing(spark):
    errors = pricing.prediction_errors(spark.createDataFrame([("a", 2.0, 1.0), ("b", 3.0, 3.0)], "item_key string, unit_price double, expected double"), spark.createDataFrame([("a",)], "item_key string"))
    assert pricing.evaluated(errors).first().n == 2
    for bad in (errors.limit(0), errors.withColumn("ape", F.lit(None).cast("double")), errors.withColumn("log_error", F.lit(float("inf"))), errors.withColumn("unit_price", F.lit(0.0))):
        with pytest.raises(ValueError):
            pricing.evaluated(bad)


def test_permuted_keeps_values(spark):
    df = spark.range(3000).select("id", (F.col("id") * 2).alias("x"))
    out = models.permuted(df, "x", "id").toPandas()
    assert sorted(out.x) == sorted(2 * k for k in range(3000)) and (out.x != 2 * out.id).mean() > 0.9


def _priced(spark, first, last):
    """Prices that follow the item and fall with the quantity, with a little noise."""
    k = F.col("id")
    rows = spark.range(first, last).select("id", F.concat(F.lit("i"), k % 7).alias("item_key"), F.concat(F.lit("c"), k % 7 % 3).alias("category"), F.lit("SP").alias("uf"), (1.0 + k % 11).alias("quantity"))
    return models.engineer(rows.withColumn("unit_price", F.exp(1 + F.substring("item_key", 2, 1).cast("double") - 0.1 * F.log1p("quantity") + 0.01 * (F.abs(F.xxhash64("id")) % 100) / 100)))


def test_tuning_in_two_stages(spark):
    prior = models.target_mean(_priced(spark, 0, 300))
    train, later = (models.with_prior(_priced(spark, *r), prior, 0.0) for r in ((0, 300), (300, 400)))
    out = models.tuned(train, later, candidates=((1, 10), (3, 10)), first=(1, 150), rounds=3, steps=(0.05, 0.3)).toPandas()
    one, two = out[out.stage == 1], out[out.stage == 2]
    assert sorted(zip(one.depth, one.least)) == [(1, 10), (1, 150), (3, 10)] and list(out["rank"]) == [1, 2, 3, 4, 5]
    assert set(zip(two.depth, two.least, two.step)) == {(3, 10, 0.05), (3, 10, 0.3)} and list(out.mae_log) == sorted(out.mae_log)
    assert (out.depth[0], out.least[0]) == (3, 10) and out.gain_pct[0] >= one.gain_pct.max() > 0
    assert one[one.least == 150].gain_pct.iloc[0] == 0 and one.rounds.between(1, 3).all() and two.rounds.between(1, 6).all()


def test_the_planted_feature_has_the_largest_effect(spark):
    rows = models.with_prior(_priced(spark, 0, 600), models.target_mean(_priced(spark, 0, 600)), 0.0)
    model = models.trees(rows, rounds=3)
    out = {r.feature: (r.increase, r.own) for r in models.importance(model, rows, ["log_quantity", "prior", "category", "uf"], "id").collect()}
    assert max(out, key=lambda f: out[f][0]) == "prior" and out["prior"][0] > 10 * max(abs(out["uf"][0]), 1e-9) and out[""] == (0.0, None)
    assert max((f for f in out if f), key=lambda f: out[f][1]) == "prior" and abs(sum(v for f, (_, v) in out.items() if f) - 1) < 1e-6
    assert models.own_importance(models.ridge(rows)) == {}


def test_unseen_levels_are_missing(spark):
    rows = [("a", "SP", 1), ("b", None, 1), ("c", "RJ", 2), (None, "SP", 2)]
    df = spark.createDataFrame(rows, "category string, uf string, part int").fillna(models.MISSING, ["category", "uf"])
    levels = models.vocabulary(df.filter("part = 1"))
    assert sorted(map(tuple, levels.collect())) == [("category", "a", 1), ("category", "b", 1), ("uf", "SP", 1), ("uf", models.MISSING, 1)]
    got = sorted(map(tuple, models.with_levels(df, levels).select("category", "uf", "part").collect()))
    assert got == sorted([("a", "SP", 1), ("b", models.MISSING, 1), (models.MISSING, models.MISSING, 2), (models.MISSING, "SP", 2)])


def test_samples_are_bounded_whole_and_the_same(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 == 9, "b").alias("g")).unionByName(spark.createDataFrame([(7, "hot"), (7, "hot")], "id long, g string"))
    per = {r.g: r["count"] for r in tables.sampled(df, 300, "id", ["g"]).groupBy("g").count().collect()}
    assert per == {"hot": 300, "b": 250, None: 250}
    ids = lambda n: sorted(r.id for r in tables.sampled(df.repartition(n), 50, "id").collect())
    md5 = lambda k: stats_md5(f"42-{k}".encode()).hexdigest()
    assert ids(2) == ids(7) == sorted(sorted([*range(5000), 7, 7], key=lambda k: (md5(k), k))[:50])
    assert tables.sampled(df.limit(0), 5, "id").count() == 0


def test_out_of_time_protocol(spark):
    train, test = _priced(spark, 0, 300), _priced(spark, 300, 400).withColumn("item_key", F.when(F.col("id") < 310, F.lit("i9")).otherwise(F.col("item_key")))
    out = {r["sample"]: r for r in models.out_of_time(train, test, "id", models.ridge).collect()}
    assert (out["all"]["n"], out["known"]["n"], out["unseen"]["n"]) == (100, 90, 10)
    assert out["known"]["mae_log"] < 0.3 < out["unseen"]["mae_log"]
    none = {r["sample"]: r for r in models.out_of_time(train, test.filter("id >= 310"), "id", models.ridge).collect()}
    assert none["unseen"]["n"] == 0 and none["unseen"]["mae_log"] is None
    for a, b in ((train, _priced(spark, 299, 310)), (train.unionByName(train.limit(1)), test), (train, test.unionByName(test.limit(1)))):
        with pytest.raises(ValueError):
            models.out_of_time(a, b, "id", models.ridge)


def test_validation_run_is_repeatable(spark, tmp_path):
    train, later = _priced(spark, 0, 300), _priced(spark, 300, 400)
    runs = [models.validation_run("ridge", train, later, models.ridge, str(tmp_path), "id").collect() for _ in range(2)]
    assert runs[0] == runs[1] and runs[0][0]["n"] == 100 and runs[0][0]["model"] == "ridge"
    assert spark.read.parquet(f"{tmp_path}/ridge/errors.parquet").count() == 100


def test_bronze_to_gold(spark):
    names = (
        "id_compra_item cod_fornecedor nome_fornecedor cod_item_catalogo descricao_resumida material_ou_servico_nome unidade_medida quantidade quantidade_resultado"
        " valor_unitario_resultado valor_total_resultado data_inclusao_pncp data_resultado id_compra orgao_entidade_cnpj COD_RESULTADO_ITEM"
    ).split()
    rows = [
        ("A", "F1", "Fornecedor A", "1", "Notebook Dell", "Material", "Unidade", "10", "10", "2900.0", "29000.0", "2025-01-01", "2025-01-02", "p1", "00394502000144", "R1"),
        ("A", "F1", "Fornecedor A", "1", "Notebook Dell", "Material", "Unidade", "10", "10", "2900.0", "29000.0", "2025-01-01", "2025-01-02", "p1", "00394502000144", "R2"),
        ("B", "F2", "Fornecedor B", None, "Mouse Optico", "Material", "Unidade", "5", "5", "50.0", "250.0", "2025-01-01", "2025-01-01", "p1", "00394502000144", "R3"),
        ("B", "F2", "Fornecedor B", None, "Mouse Optico", "Material", "Unidade", "5", "5", "55.0", "275.0", "2025-01-01", "2025-01-05", "p1", "00394502000144", "R4"),
        ("C", "F3", "Fornecedor C", None, "Consultoria TI", "Serviço", "Unidade", "1", "1", "200.0", "200.0", "2025-01-01", "2025-01-03", "p1", "00394502000144", "R5"),
        ("C", "F3", "Fornecedor C", None, "Consultoria TI", "Serviço", "Unidade", "1", "1", "210.0", "210.0", "2025-01-01", "2025-01-03", "p1", "00394502000144", "R6"),
        ("D", "F4", "Fornecedor D", "2", "Cadeira Escritorio", "Material", "Unidade", "2", "2", "480.0", "960.0", "2025-02-01", "2025-02-02", "p3", "00394502000144", "R7"),
        ("E", "F5", None, None, "Fruta", "Material", "Quilograma", "100", None, None, None, "2025-03-01", None, "p1", "00394502000144", None),
    ]
    bronze = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    headers = spark.createDataFrame([("p1", "00394502000144", "COMANDO DA MARINHA", "RJ", "Rio de Janeiro", 6, "Pregão - Eletrônico")], "id_compra string, orgao_entidade_cnpj string, orgao_entidade_razao_social string, unidade_orgao_uf_sigla string, unidade_orgao_municipio_nome string, codigo_modalidade int, modalidade_nome string")
    report, silver = cleaning.silver_with_report(bronze)
    report = {r.metric: r.value for r in report.collect()}
    assert (report["rows_raw"], report["rows_without_duplicates"], report["rows_clean"], report["rows_conflicting"]) == (8, 7, 6, 2)
    assert {r.descricao_resumida: r.category for r in silver.collect()} == {"Notebook Dell": "TI / Informatica", "Consultoria TI": "Consultoria / Servicos Profissionais", "Cadeira Escritorio": "Mobiliario / Material de Escritorio", "Mouse Optico": None, "Fruta": None}
    buyers = star.dim_buyer(headers)
    assert star.buyer_grain(buyers).first().is_valid
    with pytest.raises(ValueError):
        star.dim_buyer(headers.drop("modalidade_nome"))
    keyed = silver.withColumn("item_key", text.item_key(F.col("descricao_resumida")))
    items = star.dim_item(keyed, code="cod_item_catalogo", modes={"material_ou_servico_nome": "kind"}, unit="unidade_medida")
    fact = star.fact_of_silver(silver, buyers, items).cache()
    assert items.count() == 5 and fact.count() == 5 and fact.filter("date_key is null or item_key is null").count() == 0
    assert fact.filter("unidade_orgao_uf_sigla is null").select("purchase_item_id", "buyer_key").collect() == [("D", "00394502000144")]
    assert fact.filter("purchase_item_id = 'B'").first().unit_price == 55.0 and star.join_audit(silver.filter("valor_unitario_resultado is not null"), buyers, "id_compra").first().unmatched == 1
    joined, audit = joins.with_headers(silver.withColumn("esfera", F.lit(1)), headers.withColumn("esfera", F.lit(2)), "id_compra")
    assert tuple(audit.first()) == (6, 6, 1) and joined.filter("esfera = 1").count() == 6 and joined.filter("esfera_header = 2").count() == 5
    grain = star.grain_violations(fact, ["purchase_item_id", "supplier_key"], "resultado_conflitante").first()
    assert (grain.violating_rows, grain.unflagged_groups) == (2, 0)


def test_merging_a_batch_again_changes_nothing(spark, tmp_path):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-01", 2), ("b", "2024-01-01", 3), ("b", "2024-01-02", 4)]
    batch, target = spark.createDataFrame(rows, "k string, d string, v int"), str(tmp_path / "latest")
    for _ in range(3):
        ingest.merge_latest(spark, batch, 0, target, ["k"], "d")
    assert sorted((r.k, r.d, r.v) for r in ingest.read_latest(spark, target, ["k"], "d").collect()) == [("a", "2024-01-01", 1), ("a", "2024-01-01", 2), ("b", "2024-01-02", 4)]


def test_savings_confidence_and_guards(spark):
    rows = [(False, False, False, False, False), (True, False, False, False, False), (True, True, False, False, False), (False, None, None, None, None)]
    df = spark.createDataFrame(rows, "high_ticket boolean, few_history boolean, unit_not_comparable boolean, total_mismatch boolean, conflicting boolean")
    assert [r.confidence for r in pricing.savings_confidence(df).collect()] == ["Alta", "Revisao Alto Valor", "Baixa", "Alta"]
    with pytest.raises(ValueError):
        pricing.savings_priority(df, "id", 0.9, 0.7)
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id int, c string, abs_log_error double")
    assert comparison.paired(a, a, "id", "c").agg(F.sum("delta")).first()[0] == 0
    with pytest.raises(ValueError):
        comparison.paired(a, a.filter("id = 1"), "id", "c")
    same = resampling.clustered_bootstrap(comparison.paired(a, a.withColumn("abs_log_error", F.col("abs_log_error") + 1), "id", "c"), "c", "delta").first()
    assert (same.delta, same.low, same.verdict) == (1.0, 1.0, "reference_better")


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert files.read_manifest(spark, path).count() == 0
    files.record(spark, path, "item", "dt=1", "success", 10, 3)
    assert [(r.path, r.status, r.length) for r in files.read_manifest(spark, path).collect()] == [("dt=1", "success", 10)]
    with pytest.raises(ValueError):
        files.record(spark, path, "item", "dt=1", "done")


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        joins.checked_join(a, b, ["k"])
    assert joins.checked_join(b, a, ["k"]).count() == 2
    assert joins.same_keys(a, b, ["k"])


def test_files_and_manifest(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,supplier\n1,00123456000199\nbad,row,extra\n")
    df = files.csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "id int, supplier string", 2025)
    assert [tuple(r) for r in df.select("id", "supplier").collect()] == [(1, "00123456000199")]
    with pytest.raises(FileNotFoundError):
        files.read_years(spark, str(tmp_path / "out"), [2024])
    done = spark.createDataFrame([("a", None, 5, "success"), ("b", "item", 5, "error")], "path string, dataset string, length long, status string")
    new = spark.createDataFrame([("a", "item", 5), ("b", "item", 5), ("a", "item", 6)], "path string, dataset string, length long")
    assert sorted(tuple(r) for r in files.to_load(new, done).select("path", "length").collect()) == [("a", 6), ("b", 5)]
    tables = {n: spark.range(1) for n in files.STAR}
    files.save_star(tables, str(tmp_path / "gold"))
    assert set(files.load_star(spark, str(tmp_path / "gold"))) == set(files.STAR)


def test_streams(spark, tmp_path):
    source, target = tmp_path / "drop", str(tmp_path / "bronze")
    source.mkdir()
    (source / "1.csv").write_text("k,d,v\na,2025-01-01,1\nb,2025-01-01,1\n")
    run = lambda: ingest.ingest_daily(spark, str(source), target, str(tmp_path / "cp"), "k string, d string, v int", str(tmp_path / "manifest"))
    run()
    (source / "2.csv").write_text("k,d,v\na,2025-01-02,2\n")
    run()
    run()
    assert spark.read.parquet(target).count() == 3
    latest = str(tmp_path / "latest")
    stream = spark.readStream.schema("k string, d string, v int").parquet(target)
    ingest.keep_latest(spark, stream, latest, str(tmp_path / "cp2"), ["k"], "d")
    assert sorted((r.k, r.v) for r in ingest.read_latest(spark, latest, ["k"], "d").collect()) == [("a", 2), ("b", 1)]


def test_models_of_equal_errors_rank_by_name(spark):
    """Their means differ in the last place, as sums do that run in another order."""
    rows = lambda x: spark.createDataFrame([("r", 1.0, x, x)], "id string, unit_price double, log_error double, abs_log_error double")
    out = comparison.same_sample({"a": rows(0.1 + 0.2), "b": rows(0.3)}, "a", "id", "unit_price")
    assert {r.model: r["rank"] for r in out.collect()} == {"a": 1, "b": 2}


def exchanges(df):
    """Shuffles by a hash in the plan of a DataFrame."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_outliers_of_all_values_take_one_shuffle(spark):
    rows = spark.range(500).select((F.col("id") % 7).cast("string").alias("item_key"), *((F.col("id") % k + 1.0).alias(c) for k, c in ((11, "unit_price"), (13, "quantity"), (17, "total_price"))))
    assert exchanges(star.flag_value_outliers(rows, "item_key", ["unit_price", "quantity"])) == 1


def test_outliers_of_large_groups_and_without_key(spark, monkeypatch):
    k = F.col("id")
    x = F.when(k % 97 == 0, None).when(k % 3 == 0, 5.0).otherwise(F.exp((k * 7919 % 1000) / 40.0))
    item = F.when(k % 10 < 7, "hot").when(k % 10 == 7, "b").when(k < 60, "few").when(k < 70, F.concat(F.lit("one"), k))  # the others have none
    df = spark.range(1000).select("id", item.alias("item_key"), x.alias("quantity"), F.lit(2.0).alias("unit_price"))
    found = []
    for few in (60, 10_000):
        monkeypatch.setattr(tables, "FEW", few)
        found.append({r.id: r for r in star.flag_value_outliers(df, "item_key").collect()})
    one, two = found
    assert one.keys() == two.keys() == set(range(1000))
    for i in one:
        assert (one[i].group_rows, one[i].reason, one[i].z_unit_price) == (two[i].group_rows, two[i].reason, two[i].z_unit_price)
        assert one[i].z_quantity == two[i].z_quantity or one[i].z_quantity == pytest.approx(two[i].z_quantity, rel=1e-9)
        assert one[i].item_key or (one[i].group_rows is None and one[i].z_quantity is None)


def test_cleaned_rows_are_written_once_after_one_shuffle(spark, monkeypatch):
    written = []
    monkeypatch.setattr(cleaning, "stored", lambda df: written.append(df) or tables.stored(df))
    row = ("A", "F1", "Mouse", "10.0", "2025-01-02", "1")
    rows = [row, row[:5] + (None,), row[:3] + ("11.0",) + row[4:], ("B", "F1", "Mouse", "1.0", "2025-01-02", "1"), ("B", "F1", "Mouse", "1.0", "2025-01-03", "1"), *[(None, *row[1:])] * 3, (None, *row[1:4], "2025-01-09", "1")]
    bronze = spark.createDataFrame(rows, "id_compra_item string, cod_fornecedor string, descricao_resumida string, valor_total_resultado string, data_resultado string, valor_total string")
    report, silver = cleaning.silver_with_report(bronze)
    assert {r.metric: r.value for r in report.collect()} == {"rows_raw": 9, "rows_without_duplicates": 6, "rows_clean": 5, "rows_conflicting": 2, "rows_relevant": 0, "spend_gross": 42.0, "spend_net": 21.0}
    assert sorted((r.id_compra_item or "", str(r.data_resultado)[:10], r.valor_total, r.resultado_conflitante) for r in silver.select("id_compra_item", "data_resultado", F.coalesce("valor_total", F.lit(-1.0)).alias("valor_total"), "resultado_conflitante").collect()) == [
        ("", "2025-01-02", 1.0, False), ("", "2025-01-09", 1.0, False), ("A", "2025-01-02", -1.0, True), ("A", "2025-01-02", 1.0, True), ("B", "2025-01-03", 1.0, False),
    ]
    assert len(written) == 1 and exchanges(written[0]) == 1


def test_opportunities_join_attributes_to_few_rows(spark, monkeypatch):
    """No step reads item rows with all their tables, and the rows of the baseline are made once."""
    from spendlake.plans import analytics, opportunities

    asked, split = [], []
    for module in (analytics, opportunities):
        monkeypatch.setattr(module, "items", lambda s, d, *names, f=module.items: asked.append(names) or f(s, d, *names))
    monkeypatch.setattr(analytics, "_split", lambda *a, f=analytics._split: split.append(a) or f(*a))
    assert opportunities._audited(spark, "/root/testdata/sf0.001", "uf").filter("uf is null or unit_item is null").count() == 0
    assert len(split) == 1 and all(names and not {"uf", "supplier_name", "segment", "buyer_key"} & set(names) for names in asked)


def test_draws_level_by_level_are_those_of_the_tree(spark):
    sizes = resampling.np.array([3, 0, 5, 8, 0, 0, 1, 7])
    got = {(r.b, r.leaf): r.t for r in resampling.dealt_by_level(spark, sizes, 42, 60, 4).collect()}
    assert got == {(b, k): t for b in range(60) for k, t in enumerate(resampling.dealt(sizes, 42, b).tolist()) if t}


def test_audit_writes_names_of_opportunities_alone(spark, monkeypatch):
    from spendlake.plans import analytics, opportunities

    written = []

    def kept(df, f=tables.stored):
        written.append(f(df))
        return written[-1]

    for module in (analytics, opportunities, tables):
        monkeypatch.setattr(module, "stored", kept)
    n = opportunities._audited(spark, "/root/testdata/sf0.001").count()
    sizes = [(df.count(), {"id", "purchase_item_id", "supplier_key"} & set(df.columns)) for df in written]
    assert n and max(size for size, _names in sizes) > 10 * n  # rows of the baseline are written, by their numbers
    assert all(size <= n for size, names in sizes if names)


def test_gold_fact_makes_its_rows_once_however_large_the_groups(spark, monkeypatch):
    from spendlake import registry
    from tests import compare

    written = []
    for module in (cleaning, tables):
        monkeypatch.setattr(module, "stored", lambda df, f=tables.stored: written.append(df) or f(df))
    monkeypatch.setattr(tables, "FEW", 20)  # items have more rows
    d = "/root/testdata/sf0.001"
    out = registry.QUERIES["gold_fact"](spark, d)
    assert not written and out._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    assert compare.rows(out.toPandas()) == compare.rows(compare.oracle(d, registry.SQL["gold_fact"]))


def test_bronze_report_reads_the_lines_and_their_parts_twice(spark):
    from spendlake import registry

    out = registry.QUERIES["bronze_report"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 4


def test_bronze_report_of_copies_and_gaps(spark):
    row = ("k", "s", 1.0, "2025-01-01", "i", "KG")
    rows = [row, row, row[:2] + (-1.0,) + row[3:], (None, "s", 0.0, "n/a", "i", "G"), (None, "s", 0.0, "n/a", "i", "G"), (None, None, None, None, None, "KG"), (None, None, None, None, None, "G"), ("z", "s", 2.0, None, "j", None)]
    df = spark.createDataFrame(rows, "k string, s string, p double, d string, i string, u string")
    report = lambda df: {(r["check"], r["column"], r["metric"]): r["value"] for r in quality.bronze_report(df, ["k", "s", "p", "d", "i", "x"], ["k", "s"], "p", ["d"], "i", "u", "s").collect()}
    drift = {("drift", "u", "new"): 1, ("drift", "x", "missing"): 1}
    assert report(df) == {
        ("shape", "", "rows"): 8, ("range", "p", "below"): 1, ("range", "p", "zero"): 2, ("reference", "s", "missing"): 2, ("dates", "d", "invalid"): 2, ("duplicates", "", "exact"): 2, ("duplicates", "k,s", "key"): 4,
        ("units", "i", "items"): 2, ("units", "i", "mixed"): 1, **{("nulls", c, "n"): n for c, n in zip("kspdiu", (4, 2, 2, 3, 2, 1), strict=True)}, **drift,
    }
    assert set(report(df.limit(0)).values()) == {0, 1} and len(report(df.limit(0))) == len(report(df))


def test_draws_that_no_sql_fixes_are_numpys(spark, monkeypatch):
    from spendlake.plans import reports

    rows = [(f"c{k % 300}" if k % 7 else None, float(k % 11) - 5) for k in range(3000)]
    pairs = spark.createDataFrame(rows, "item_key string, delta double")
    quick = lambda df, times: resampling.resampled(df, "item_key", "delta", times, leaf=16, fixed=False).toPandas().sort_values("b").reset_index(drop=True)
    got, n = quick(pairs, 400), len({c for c, _ in rows})
    assert len(got) == 400 and (got.n == n).all() and len(got.c.unique()) > 50
    assert (quick(pairs.repartition(3), 400) - got).abs().max().max() < 1e-9  # in any run
    per = pairs.groupBy("item_key").agg(F.sum("delta").alias("s"), F.count("*").alias("c")).toPandas()
    for name in "sc":  # moments of a multinomial sum
        x, y = per[name].to_numpy(float), got[name].to_numpy(float)
        spread = resampling.np.sqrt(n * x.var())
        assert abs(y.mean() - x.sum()) < 4 * spread / 20 and abs(y.std() / spread - 1) < 0.15
    assert quick(pairs.limit(0), 5).empty
    asked = []
    monkeypatch.setattr(reports.comparison, "compare_models", lambda *a, **how: asked.append(how) or a[0])
    monkeypatch.setattr(reports.models, "fitted_errors", lambda train, later, fit: later.withColumn("abs_log_error", F.lit(0.0)))
    reports.analytics.QUERIES["tuned_against_first"](spark, "/root/testdata/sf0.001")
    assert asked == [{"fixed": False}]


def test_paired_rows_cross_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(comparison, "stored", lambda df: written.append(df) or tables.stored(df))
    rows = lambda *rows: spark.createDataFrame(rows, "id string, c string, abs_log_error double")
    a = rows(("x", "k", 1.0), ("y", None, 2.0))
    out = comparison.paired(a, rows(("x", "k", 1.5), ("y", None, 1.0)), "id", "c")
    assert {tuple(r) for r in out.collect()} == {("x", "k", 0.5), ("y", None, -1.0)} and len(written) == 1 and exchanges(written[0]) <= 1
    more = rows(("x", "k", 1.5), ("y", None, 1.0), ("z", "k", 1.0), (None, "k", 1.0))
    assert comparison.paired(a, more, "id", "c", whole=False).count() == 2
    for one, two, why in ((a, more, "differ"), (more, more, "differ"), (a, a.limit(1), "differ"), (a.union(a), a, "repeats in the reference"), (a, a.union(a), "repeats in the challenger"), (a, rows(("x", "q", 1.0), ("y", None, 1.0)), "c differs")):
        with pytest.raises(ValueError, match=why):
            comparison.paired(one, two, "id", "c")
