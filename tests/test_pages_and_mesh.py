import json

from pyspark.sql import functions as F

from casemart.functions import measures
from casemart.plans import classify, geography
from casemart.sources import files

PAGE = """<html><style>MEDICINA LEGAL</style><h1>Superintendência Regional de Polícia Científica em Y – PCI/SRY</h1>
<p>Vinculado à Superintendência Regional de Polícia Científica em Lages</p>
<section><h2>medicina legal</h2><p>Rua das Flores, 10 – Centro (fundos)</p>(48) 3333-1111
Plantão 24h todos os dias</section>
<section><h2>Identificação</h2> sem telefone</section>
<section>Medicina Legal (48) 3333-2222</section></html>"""


def units(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return {r.page_id: r for r in files.page_units(rows).collect()}


def test_services_of_a_page(spark):
    got = units(spark, PAGE, None, "", "<p>nothing</p>", "IDENTIFICAÇÃO")
    s = got[0].servicos
    assert (s.medicina_legal.endereco, s.medicina_legal.telefone, s.medicina_legal.horario) == ("Rua das Flores, 10 – Centro", "(48) 3333-2222", "Plantão 24h todos os dias")
    assert s.medicina_legal.disponivel and s.criminalistica is None
    assert s.identificacao.disponivel and s.identificacao.telefone is None and s.identificacao.nome == "Identificação sem telefone"
    assert got[0].nome_unidade.endswith("PCI/SRY") and got[0].latitude is None
    assert all(got[k].servicos is None for k in (1, 2, 3)) and got[4].servicos.identificacao.disponivel
    flat = files.facilities(files.page_units(spark.createDataFrame([(0, PAGE)], "page_id long, html string"))).first()
    assert (flat.telefone, flat.tem_medicina_legal, flat.tem_criminalistica, flat.tem_identificacao) == ("(48) 3333-2222", True, False, True)


def test_parts_lose_nothing(spark):
    parts = files.page_sections(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).orderBy("page_id", "nth").collect()
    assert [(r.page_id, r.nth, r.service) for r in parts] == [(1, 0, None), (1, 1, "medicina_legal"), (1, 2, "identificacao"), (1, 3, "medicina_legal"), (2, 0, None)]


def feature(code, kind, coordinates):
    return {"type": "Feature", "properties": {"codarea": code}, "geometry": {"type": kind, "coordinates": coordinates}}


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


def test_mesh_of_several_depths(spark, tmp_path):
    features = [
        feature("1", "Polygon", [square(-50, -28, 2), square(-49.5, -27.5, 1)]),
        feature(2, "MultiPolygon", [[square(0, 0, 2)], [square(10, 0, 2), square(10.5, 0.5, 1)]]),
        feature("3", "Point", [1.5, 2.5]),
        feature("4", "Polygon", []),
        feature("  ", "Polygon", [square(0, 0, 1)]),
        {"type": "Feature", "properties": {}, "geometry": None},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "b.geojson").write_text(json.dumps(feature("9", "Polygon", [square(4, 4, 2)])))
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    mesh = files.read_mesh(spark, str(tmp_path))
    assert [c for c, _ in mesh.dtypes] == ["codarea", "kind", "polygons"]
    got = {r.codarea: r for r in mesh.collect()}
    assert set(got) == {"1", "2", "3", "4", "9"} and got["3"].polygons == [] and len(got["2"].polygons[1]) == 2
    dim = spark.createDataFrame([(c,) for c in "1239"], "ibge_code string")
    points = {r.ibge_code: (r.lat, r.lng) for r in geography.municipal_points(mesh, dim).collect()}
    assert points == {"1": (-27.0, -49.0), "2": (1.0, 6.0), "3": (-27.24, -50.21), "9": (5.0, 5.0)}


def test_measures_without_count_population_or_name(spark):
    rows = spark.createDataFrame([(32, 1000), (None, 1000), (32, None), (32, 0)], "n long, p long")
    got = {m: [r[0] for r in rows.select(measures.displayed(m, F.col("n"), F.col("p")).cast("double")).collect()] for m in (*measures.DISPLAYED, "?")}
    assert got["total"] == got["?"] == [32, 0, 32, 32] and got["media_anual"] == [2, 0, 2, 2]
    assert got["total_10k"] == [320, 0, 0, 0] and got["taxa_anual_10k"] == [20, 0, 0, 0] and got["taxa_anual_100k"] == [200, 0, 0, 0]


def test_summary_of_an_empty_batch(spark):
    none = spark.createDataFrame([], "indicio_penal long, grau_certeza string, categoria_penal string, orgao_prioritario string")
    assert [(r.value, r.n, r.share) for r in classify.summary(none).orderBy("position").collect()] == [("total", 0, None), ("penal", 0, None), ("social", 0, None)]
    many = spark.createDataFrame([(1, "ALTO", f"c{k:02}", "o") for k in range(12)], none.schema)
    assert [r.value for r in classify.summary(many).filter("field = 'categoria_penal'").orderBy("position").collect()] == [f"c{k:02}" for k in range(10)]
