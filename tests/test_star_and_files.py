import pytest
from pyspark.sql import functions as F

from casemart.operators import audit
from casemart.plans import geography, slices, star
from casemart.sources import files
from casemart.streaming import ingest

DIM = "ibge_code string, municipio_nome string, microrregiao string, regiao_imediata string, regiao_intermediaria string"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Three files of three eras, and the star schema built from them."""
    raw, out = tmp_path_factory.mktemp("raw"), str(tmp_path_factory.mktemp("star"))

    def put(name, columns, rows):
        spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)).coalesce(1).write.parquet(f"{raw}/{name}.dir")
        part = next((raw / f"{name}.dir").glob("part-*"))
        part.rename(raw / f"{name}.parquet")

    put("cases-2019", ["vitima_uf", "vitima_cod_municipio", "violacoes"], [("sc", "4200001", "ABORTO"), ("PR", "1", "ABORTO"), (" SC ", "Beta", "nada")])
    put("cases-primeiro-semestre-2020", ["UF", "hash_par_vitima_suspeito", "Município da vítima", "violacao"], [("SC", "p1", "ALFA", "AMEAÇA"), ("SC", "p2", "nowhere", "x")])
    rows = [("SC", "h1", "4200001 | ALFA", "AMEAÇA", "Mulher"), ("SC", "h1", "4200001", "x", ""), ("SC", "h1", "4200001", "x", ""), ("SC", "h2", "beta", "RACISMO", "Pessoa idosa"), ("SC", None, "beta", "x", "N/D"), ("SC", "h3", "4299999", "x", "")]
    put("cases-segundo-semestre-2020", ["UF", "hash", "Município", "violacao", "Grupo_vulnerável"], rows)
    dim = star.municipalities(
        spark.createDataFrame([("4200001", "Alfa", "m", "i", "R1"), ("4200002", "Beta", "m", "i", "R2"), ("4200003", "Gama", "m", "i", "R2")], DIM),
        spark.createDataFrame([("4200001", "10000"), ("4200002", "50000")], "ibge_code string, populacao string"),
    )
    return star.build(spark, f"{raw}/cases-*.parquet", dim, out) | {"dim": dim}


def test_fact(built):
    rows = {r.id_fato: r for r in built["fact"].collect()}
    assert len(rows) == 10
    assert rows["2019_0_2"].ibge_code == "4200002" and rows["2019_0_2"].id_denuncia is None
    assert rows["2020_1_1"].grain_denuncia_confiavel == 0 and rows["2020_1_1"].id_denuncia == "p1"
    assert rows["2020_1_2"].ibge_code == "4200000" and rows["2020_1_2"].regiao_intermediaria == "OUTRA"
    assert rows["2020_2_6"].ibge_code == "4299999" and rows["2020_2_6"].municipio_nome == "NÃO IDENTIFICADO"
    assert rows["2020_2_1"].is_mulher == 1 and rows["2020_2_4"].is_idoso == 1


def test_indicators(built):
    rows = {r.municipio_nome: r for r in built["kpi_municipality"].collect()}
    a, b, c = rows["Alfa"], rows["Beta"], rows["Gama"]
    assert (a.total_denuncias, a.total_penal, a.denuncias_unicas, a.denuncias_unicas_penal, a.denuncias_unicas_maioria_penal) == (5, 3, 1, 1, 0)
    assert a.taxa_total_10k == 5.0 and b.denuncias_unicas_maioria_penal == 1
    assert (c.total_denuncias, c.taxa_total_10k, c.populacao_censo_2022) == (0, None, None)
    assert built["kpi_period"].agg(F.sum("total_denuncias")).first()[0] == 8
    assert built["kpi_category"].agg(F.sum("registros")).first()[0] == 10
    assert built["kpi_category"].filter("regiao_intermediaria = 'OUTRA'").count() > 0


def test_slices(spark, built):
    distances = spark.createDataFrame([("4200001", 10.0, "u1"), ("4200002", 60.0, "u1")], "ibge_code string, km double, nearest string")
    f = slices.Filters(floor=20_000)
    rows = slices.take(built["kpi_municipality"], built["kpi_period"], f, distances)
    got = {r.municipio_nome: r for r in rows.collect()}
    assert got["Alfa"].halves == 4 and got["Alfa"].rate == pytest.approx(5 / 2 / 10_000 * 10_000)
    assert [got[n].band for n in ("Alfa", "Beta", "Gama")] == ["near", "far", "unknown"]
    s = slices.summary(rows, f).first()
    assert (s.total, s.penal, s.complaints) == (8, 4, 2)
    one = slices.take(built["kpi_municipality"], built["kpi_period"], slices.Filters(years=(2020,), regions=("R1",)), distances)
    assert [(r.municipio_nome, r.total_denuncias, r.halves) for r in one.collect()] == [("Alfa", 4, 2)]
    assert [r.municipio_nome for r in slices.table(rows, slices.Filters(search="BET")).collect()] == ["Beta"]
    assert [r.municipio_nome for r in slices.table(rows, slices.Filters(profile="penal")).collect()] == ["Alfa"]
    assert [r.municipio_nome for r in slices.table(rows, slices.Filters(size_band="50-100k")).collect()] == ["Beta"]
    t = slices.territory(rows, built["kpi_period"], f)
    assert [r.municipio_nome for r in t["by_rate"].collect()] == ["Beta"] and t["by_volume"].first().municipio_nome == "Alfa" and t["series"].count() == 2
    assert slices.groups(rows).count() == 7
    n = slices.penal_nature(built["kpi_category"], slices.Filters())
    assert n["totals"].first().penal == 4 + 0 and n["by_year"].count() == 2
    units = spark.createDataFrame([("x", True), ("y", False)], "tipo string, tem_criminalistica boolean")
    access = slices.forensic_access(rows, units)
    assert {r.band: r.places for r in access["bands"].collect()} == {"near": 1, "middle": 0, "far": 1} and access["services"].first().tem_criminalistica == 1


def test_bundle_and_audit(spark, built):
    d = slices.distribution(built["fact"], built["kpi_municipality"])
    assert {r.ano: r.partial for r in d["years"].collect()} == {2019: False, 2020: False}
    assert d["regions"].agg(F.sum("total_registros")).first()[0] == 10
    none = spark.createDataFrame([], "file string")
    a = slices.audit_report(built["fact"], built["dim"], none, floor=1)
    assert a["reconciliation"].first().unattributed == 2 and a["overlap"].first().rows == 10
    assert files.bundle(totals=d["totals"], regions=d["regions"]).count() == 2
    raw = files.read_period_files
    assert callable(raw)


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('nome;"x;v\nJosé;"um"" ;N/D\ncurto\nlongo;1;2;3;4\n;None;é\n'.encode("latin-1"))
    path = f"{tmp_path}/a.csv"
    assert files.detect_delimiter(spark, path) == ";" and files.detect_encoding(spark, path) == "ISO-8859-1"
    rows = [tuple(r) for r in files.read_csv(spark, path).collect()]
    assert rows == [("José", '"um"" ', None), ("curto", None, None), ("longo", "1", "2"), (None, None, "é")]
    assert files.csv_to_parquet(spark, path, f"{tmp_path}/out").filter("not passed").isEmpty()


def test_validation_sees_a_changed_value(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    report = audit.validate_copy(a, spark.createDataFrame([(1, "x"), (2, "z")], "k long, v string"))
    assert {r.check for r in report.filter("not passed").collect()} == {"content", "column v"}
    with pytest.raises(ValueError, match="column v"):
        audit.require(report)


def test_facilities_distances_exports(spark, tmp_path):
    (tmp_path / "u.json").write_text('[{"nome_unidade": "Núcleo Regional em X – PCI/SR/NRX", "latitude": -27.5, "servicos": {"medicina_legal": {"disponivel": true, "endereco": ""}, "criminalistica": {"endereco": "Rua A"}}}]')
    r = files.read_facilities(spark, f"{tmp_path}/u.json").first()
    assert (r.sigla, r.tipo, r.lat, r.lon, r.endereco, r.tem_medicina_legal, r.tem_criminalistica) == ("PCI/SR/NRX", "Núcleo Regional", -27.5, 0.0, "Rua A", True, False)
    j = spark.createDataFrame([('{"1": {"distancia_pci_km": 3.5}, "2": {"distancia_pci_km_linha_reta": 4.5, "distancia_pci_km": 1.0}}',)], "j string")
    assert {r.ibge_code: r.km for r in files.distances(j, "j").collect()} == {"1": 3.5, "2": 4.5}
    for kind in files.EXPORTS:
        files.export(spark.range(3).toDF("a"), f"{tmp_path}/{kind}", kind, ["a", "absent"])
        assert spark.read.format(kind).option("header", True).load(f"{tmp_path}/{kind}").count() == 3
    page = spark.createDataFrame([(1, '<a href="x/one.csv/view">1</a><A HREF=\'one.csv\'>2</A><a href="two.csv">3</a>')], "page_id long, html string")
    assert {(r.base_name, r.href) for r in files.links(page).collect()} == {("one", "x/one.csv/view"), ("two", "two.csv")}


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, log = (f"{tmp_path}/{n}" for n in ("src", "out", "log"))
    spark.range(5).write.parquet(src)
    for n in (5, 12):
        if n == 12:
            spark.range(5, 12).write.mode("append").parquet(src)
        ingest.land(spark, src, "id long", lambda d: d, out, log).awaitTermination()
        assert spark.read.parquet(out).count() == n
    seen = []
    ingest.land_each(spark, src, "id long", lambda d, _: seen.append(d.count()), f"{tmp_path}/log2").awaitTermination()
    assert sum(seen) == 12


def test_distance_matrix(spark):
    def square(x, y):
        return [[[[x, y], [x + 2, y], [x + 2, y + 2], [x, y + 2], [x, y]]]]

    mesh = spark.createDataFrame([("1", "Polygon", square(-50.0, -28.0)), ("2", "Polygon", square(-10.0, -28.0)), ("9", "Polygon", square(0.0, 0.0))], geography.MESH)
    dim = spark.createDataFrame([("1", "Alfa"), ("2", "Beta"), ("3", "Gama")], "ibge_code string, municipio_nome string")
    units = spark.createDataFrame([("U1", "A", -27.0, -49.0), ("U2", "B", -27.0, -8.0), ("U0", "C", 0.0, 0.0)], "sigla string, municipio string, lat double, lon double")
    got = {r.ibge_code: r for r in geography.distance_matrix(geography.municipal_points(mesh, dim), units).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].nearest, got["1"].km, got["1"].band, got["1"].nearest_town) == ("U1", 0.0, "near", "A")
    assert got["2"].nearest == "U2" and got["2"].band == "far"


def test_allocation_is_never_more_than_asked_for():
    from casemart.operators.sampling import allocation

    for counts, size in (({"a": 5, "b": 5, "c": 1}, 2), ({"a": 100, "b": 1, "c": 1}, 50), ({s: 1 for s in "abcdef"}, 6), ({"a": 2, "b": 2, "c": 2, "d": 1}, 5), ({"a": 3}, 10)):
        got = allocation(counts, size)
        assert sum(got.values()) == min(size, sum(counts.values())) and all(0 <= got[s] <= counts[s] for s in counts)


def test_late_rows_and_state_between_runs(spark, tmp_path):
    """Rows of an open window that come in a later run are added to it; rows behind the watermark are not."""
    src, out, log = (f"{tmp_path}/{n}" for n in ("src", "out", "log"))
    ddl, day = "t timestamp, u string", "2024-01-{:02d} 10:00:00"
    said = []
    for batch in ([(1, "a"), (2, "b"), (9, "c")], [(3, "b"), (10, "d"), (30, "e")], [(2, "late"), (30, "f")]):
        rows = spark.createDataFrame([(day.format(d), u) for d, u in batch], "t string, u string").select(F.col("t").cast("timestamp").alias("t"), "u")
        rows.coalesce(1).write.mode("append").parquet(src)
        ingest.run_kpi(spark, src, ddl, "t", "7 days", "7 days", "u", out, log).awaitTermination()
        said.append({str(r.from_time)[:10]: (r.records, r.ids) for r in ingest.latest(spark.read.parquet(out)).collect()})
    assert said[0] == {"2023-12-28": (2, 2), "2024-01-04": (1, 1)}
    assert said[1] == {"2023-12-28": (3, 2), "2024-01-04": (2, 2), "2024-01-25": (1, 1)}
    assert said[2] == said[1] | {"2024-01-25": (2, 2)}
