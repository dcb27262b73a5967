import math

import pytest
from pyspark.sql import functions as F

from casemart import config
from casemart.functions import geo
from casemart.functions import measures as m
from casemart.functions import text as tx
from casemart.operators import harmonise as h
from casemart.operators.sampling import allocation
from casemart.plans import classify


def values(spark, f, *inputs):
    df = spark.createDataFrame([(n, x) for n, x in enumerate(inputs)], "n long, x string")
    return [r[0] for r in df.orderBy("n").select(f(F.col("x"))).collect()]


def test_keys(spark):
    want = {"Gênero_da_vítima": "genero_da_vitima", "Município  da vítima": "municipio_da_vitima", "Deficiência relacionada a doença rara ?": "deficiencia_relacionada_a_doenca_rara", "": "", "ÇÃO!": "cao"}
    assert [tx.key_of(k) for k in want] == list(want.values())
    assert values(spark, tx.normal_key, *want) == list(want.values())
    assert values(spark, tx.normal_key, None) == [""]


def test_clean(spark):
    assert values(spark, tx.clean, "N/D", "NÃO TEM DEFICIÊNCIA", "NÃO SE APLICA - VÍTIMA COMUNIDADE/FAMÍLIA", None, " \t", " Água ") == ["", "", "", "", "", "ÁGUA"]


def test_ages(spark):
    def of(f):
        return lambda c: f(tx.clean(c), tx.age_range_of(tx.clean(c)))

    got = values(spark, lambda c: tx.age_range_of(tx.clean(c)), "12 a 14 anos", "40 A 44 ANOS", "08 ANOS", "80 anos ou mais", "00 a 1 ano", "Recem-nascido", "N/D", "61 a 60 anos")
    assert [r and (r.lo, r.hi) for r in got] == [(12, 14), (40, 44), (8, 8), (80, 120), (0, 1), (0, 0), None, (60, 61)]
    assert values(spark, of(tx.is_child), "56 a 60 anos", "40 A 44 ANOS", "17 ANOS", "adolescente", None) == [False, False, True, True, False]
    assert values(spark, of(tx.is_elderly), "56 a 60 anos", "60 A 64 ANOS", "idosa", "91 anos ou mais") == [False, True, True, True]


def test_municipality(spark):
    assert values(spark, tx.municipality_code, "4205407", "4205407 | FLORIANOPOLIS", "3550308", "NI", None) == ["4205407", "4205407", None, None, None]
    assert values(spark, tx.municipality_key, "Icara", "IÇARA", "içara (SC)", "12 - Içara", "NI", "<NA>", "") == ["icara"] * 4 + [None] * 3


def test_numbers_modules_units(spark):
    assert values(spark, tx.plain_number, "1.234", " 12,345 ", "n/d", "") == [1234, 12345, None, None]
    assert values(spark, tx.declared_modules, "Criança e Adolescente / PESSOA IDOSA", None) == [["is_crianca", "is_idoso"], []]
    assert values(spark, tx.facility_code, "Núcleo X - PCI/SRLGS/NRCTB") == ["PCI/SRLGS/NRCTB"]
    df = spark.createDataFrame([("Superintendência em Lages Maria Silva nrlgs", "Maria Silva"), ("Sede nrabc", "")], "p string, r string")
    assert [r[0] for r in df.select(tx.parent_unit(F.col("p"), F.col("r"))).collect()] == ["Superintendência em Lages", "Sede"]


def case(spark, **fields):
    return spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields))


@pytest.mark.parametrize(
    ("fields", "category", "degree"),
    [
        ({"violacao": "aborto e ameaça"}, "CRIMES_CONTRA_A_VIDA", "ALTO"),
        ({"violacao": "NEGLIGÊNCIAXABANDONO"}, "REDE_DE_PROTECAO_SOCIAL", "BAIXO"),
        ({"violacao": "negligência.abandono"}, "CRIMES_DE_ABANDONO_E_OMISSAO", "MEDIO"),
        ({"violacao": "humilhação", "grupo_vulneravel": "PESSOA IDOSA", "genero_vitima": "feminino"}, "VIOLENCIA_PSICOLOGICA_CONTRA_IDOSO", "MEDIO"),
        ({"violacao": "humilhação", "genero_vitima": "F"}, "VIOLENCIA_PSICOLOGICA_CONTRA_MULHER", "MEDIO"),
        ({"violacao": "x", "cenario_violacao": "DELEGACIA"}, "INFRACAO_PENAL_REFUGIO_CENARIO_POLICIAL_OU_PRISIONAL", "ALTO"),
        ({"violacao": "x", "suspeito_preso": "sim"}, "REDE_DE_PROTECAO_SOCIAL", "BAIXO"),
        ({"violacao": None}, "REDE_DE_PROTECAO_SOCIAL", "BAIXO"),
    ],
)
def test_penal(spark, fields, category, degree):
    r = classify.penal(case(spark, **fields)).first()
    assert (r.categoria_penal, r.grau_certeza) == (category, degree)


def test_groups(spark):
    r = classify.groups(case(spark, genero_vitima="feminino", motivacao="COMPANHEIRO")).first()
    assert r.is_mulher == 1 and r.grupo_primario == "MULHERES_VIOLENCIA_GENERO"
    assert classify.groups(case(spark, genero_vitima="feminino", motivacao="outra")).first().is_mulher == 0
    r = classify.groups(case(spark, faixa_etaria_vitima="12 a 14 anos", deficiencia_vitima="física")).first()
    assert (r.is_crianca, r.is_pcd, r.grupo_primario, r.qtd_grupos) == (1, 1, "CRIANCAS_E_ADOLESCENTES", 2)
    assert classify.groups(case(spark, vitima_presa="sim")).first().is_prisional_rua == 1
    r = classify.groups(case(spark, deficiencia_vitima="N/D")).first()
    assert r.sem_grupo == 1 and r.sinais == []


def test_measures(spark):
    df = spark.createDataFrame([(10, 0, 24.9), (10, None, 25.0), (10, 1000, 50.0), (10, 50_000, 50.1), (0, 5, None)], "n long, p long, km double")
    assert [r[0] for r in df.select(m.rate(F.col("n"), F.col("p"))).collect()] == [None, None, 100.0, 2.0, 0.0]
    assert [r[0] for r in df.select(m.distance_band(F.col("km"))).collect()] == ["near", "middle", "middle", "far", "unknown"]
    assert [r[0] for r in df.select(m.population_band(F.col("p"))).collect()] == ["<20k", None, "<20k", "50-100k", "<20k"]


def test_geo(spark):
    df = spark.createDataFrame([([[[[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]], "Polygon"), ([[[[1.0, 1.0], [3.0, 3.0], [1.0, 1.0]]]], "Polygon"), ([[[[0.0, 0.0]]]], "Point")], "g array<array<array<array<double>>>>, k string")
    got = [(r[0].lat, r[0].lng) for r in df.select(geo.shape_centroid(F.col("k"), F.col("g"))).collect()]
    assert got[0] == pytest.approx((1.0, 2.0)) and got[1] == pytest.approx((5 / 3, 5 / 3)) and got[2] == config.FALLBACK_POINT
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert km == pytest.approx(math.pi * 6371.0)


def test_resolution():
    r = h.resolve(["Hash", "hash_par_vitima_suspeito", "Sexo da vítima", "Genero_da_vítima", "relacao_suspeito"])
    assert r.found["id_denuncia"] == "Hash" and r.found["genero_vitima"] == "Genero_da_vítima"
    assert r.found["motivacao"] == r.found["relacao_vitima_suspeito"] == "relacao_suspeito"
    assert "uf" in r.missing and h.era(r) == "complaint_id"
    assert h.era(h.resolve(["hash par vitima suspeito"])) == "pair_id" and h.era(h.resolve(["x"])) == "no_id"


def test_allocation_sums():
    assert allocation({"a": 900, "b": 99, "c": 1}, 50) == {"a": 44, "b": 5, "c": 1}
    assert sum(allocation({"a": 7, "b": 7, "c": 7}, 10).values()) == 10
