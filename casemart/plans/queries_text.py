"""Registered queries: cleaning, resolution, classifiers, JSON and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx
from ..operators import aggregate as agg
from ..operators.harmonise import labelled
from ..sources import files
from . import classify
from .proxy import FLAGS, Book, fact, table
from .proxy import FACT as FACT_SQL

BOOK = Book()


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, {literal(t)})" for t in terms) + ")"


#: Ordered literal terms in the prose of `documents`; a point in a term is a point.
PROSE_RULES = (
    config.Rule("licence", "ALTO", "a1", "x", ("GNU General", "All rights reserved")),
    config.Rule("shouting", "ALTO", "a2", "y", ("!!",)),
    config.Rule("table", "MEDIO", "a3", "y", (" | ",)),
    config.Rule("german", "MEDIO", "a4", "z", ("ung ", "keit")),
    config.Rule("thing", "BAIXO", "a5", "z", ("thing.", "tion.")),
)
_PROSE = "CASE " + " ".join(f"WHEN {contains_any('text', r.terms)} THEN {literal(r.category)}" for r in PROSE_RULES) + " ELSE 'none' END"


@BOOK.add(f"SELECT {_PROSE} AS category, lang, count(*) AS n FROM documents GROUP BY ALL")
def taxonomy_first_match(spark, sf_dir):
    hit = classify.first_match(F.col("text"), PROSE_RULES)
    category = F.coalesce(F.get(F.array(*[F.lit(r.category) for r in PROSE_RULES]), hit), F.lit("none"))
    rows = table(spark, sf_dir, "documents").select(category.alias("category"), "lang")
    return rows.groupBy("category", "lang").agg(F.count(F.lit(1)).alias("n"))


#: Raw fields of a case, made from a part's key and size: every branch of the classifiers occurs.
VIOLATION = ("AMEAÇA", "Negligência.Abandono", "humilhação", "N/D", "NEGLIGÊNCIAXABANDONO", "Tortura física e ameaça", "Homicídio", "Racismo", "", "Retenção de salário", "estupro virtual", "Cárcere privado", "nada consta")
GROUP = ("Pessoa Idosa", "Violência contra a Mulher", "CRIANÇA E ADOLESCENTE", "Não informado", "População LGBTQIA+", "Pessoa com deficiência", "Situação de rua", "null", "Privação de liberdade", "Outros")
GENDER = ("Feminino", "MASCULINO", "NÃO SE APLICA - VÍTIMA COMUNIDADE/FAMÍLIA", "F", "N/D")
AGE = ("12 a 14 anos", "40 A 44 ANOS", "08 ANOS", "80 anos ou mais", "00 a 1 ano", "Recem-nascido", "N/D", "56 a 60 anos", "61 A 65 ANOS", "17 ANOS", "mais idoso", "adolescente")
SCENE = ("Casa da vítima", "DELEGACIA DE POLÍCIA", "Via pública", "Hospital", "Não informado", "Presídio")
CUSTODY = ("NÃO", "PENA (RECLUSÃO)", "N/D", "Sim", "Preventiva", "NÃO INFORMADO", "não", "não")
MOTIVE = ("Companheiro(a)", "conflito de ideias", "N/D", "EX-MARIDO", "Em benefício próprio")
FIELDS = {"violacao": (VIOLATION, 1), "grupo_vulneravel": (GROUP, 3), "genero_vitima": (GENDER, 7), "faixa_etaria_vitima": (AGE, 5), "cenario_violacao": (SCENE, 11), "suspeito_preso": (CUSTODY, 13), "vitima_presa": (CUSTODY, 17), "motivacao": (MOTIVE, 19), "deficiencia_vitima": (("NÃO TEM DEFICIÊNCIA", "N/D", "Física", "não"), 23), "orientacao_sexual_vitima": (("Heterossexual", "GAY", "N/D", "Lésbica", "não declarado"), 29)}


def cases(spark, sf_dir):
    def pick(values, factor):
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(F.col("p_partkey") / factor), F.lit(len(values))) + 1).cast("int"))

    return table(spark, sf_dir, "part").select("p_partkey", *[pick(v, f).alias(n) for n, (v, f) in FIELDS.items()])


def _pick_sql(name: str) -> str:
    values, factor = FIELDS[name]
    return f"([{', '.join(map(literal, values))}])[1 + CAST(floor(p_partkey / {factor}) AS BIGINT) % {len(values)}] AS {name}"


def key_sql(e: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({e})), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"


def clean_sql(e: str) -> str:
    nothing = f"{key_sql(e)} IN ({', '.join(map(literal, config.NULL_TOKENS))})" + "".join(f" OR starts_with({key_sql(e)}, {literal(p)})" for p in config.NULL_PREFIXES)
    return f"CASE WHEN {nothing} THEN '' ELSE upper(trim({e})) END"


_CASES = "WITH raw AS (SELECT p_partkey, " + ", ".join(map(_pick_sql, FIELDS)) + " FROM part), c AS (SELECT p_partkey, faixa_etaria_vitima AS age_raw, " + ", ".join(f"{clean_sql(n)} AS {n}" for n in FIELDS) + " FROM raw), t AS (SELECT *, concat_ws(' ; ', nullif(violacao, ''), nullif(grupo_vulneravel, ''), nullif(motivacao, '')) AS text, CASE " + " ".join(
    f"WHEN {contains_any(f, words)} THEN {literal(reason)}" for fields, words, reason in config.REINFORCEMENT for f in fields if f in FIELDS
) + f" ELSE {literal(config.NO_REINFORCEMENT)} END AS reason FROM c)"
_PSY = contains_any("text", config.PSYCHOLOGICAL_TERMS)
_IDX = "CASE " + " ".join(f"WHEN {contains_any('text', r.terms)} THEN {i}" for i, r in enumerate(config.TAXONOMY)) + f" WHEN {_PSY} AND {contains_any('grupo_vulneravel', ('IDOSA', 'IDOSO'))} THEN 8 WHEN {_PSY} AND (contains(grupo_vulneravel, 'MULHER') OR contains(genero_vitima, 'FEMIN') OR genero_vitima = 'F') THEN 9 WHEN reason <> {literal(config.NO_REINFORCEMENT)} THEN 10 ELSE 11 END"
_ALL = (*config.TAXONOMY, config.PSYCHOLOGICAL_ELDERLY, config.PSYCHOLOGICAL_WOMAN, config.REINFORCED, config.SOCIAL)


def _of(field: str) -> str:
    return f"([{', '.join(literal(getattr(r, field)) for r in _ALL)}])[i + 1]"


@BOOK.add(_CASES + f", d AS (SELECT *, {_IDX} AS i FROM t) SELECT p_partkey, text AS texto_caso, reason AS motivo_reforco, CAST(CASE WHEN i < 11 THEN 1 ELSE 0 END AS BIGINT) AS indicio_penal, CAST(CASE WHEN i < 10 THEN 1 ELSE 0 END AS BIGINT) AS indicio_penal_texto, CASE WHEN i = 10 THEN {_of('category')} || reason ELSE {_of('category')} END AS categoria_penal, {_of('degree')} AS grau_certeza, {_of('articles')} AS fundamentacao_legal, {_of('agency')} AS orgao_prioritario FROM d")
def penal_classifier(spark, sf_dir):
    return classify.penal(cases(spark, sf_dir)).select("p_partkey", "texto_caso", "motivo_reforco", "indicio_penal", "indicio_penal_texto", "categoria_penal", "grau_certeza", "fundamentacao_legal", "orgao_prioritario")


@BOOK.add(_CASES + f", d AS (SELECT *, {_IDX} AS i FROM t) SELECT {_of('degree')} AS grau_certeza, count(*) AS n FROM d GROUP BY 1")
def penal_degree_counts(spark, sf_dir):
    return agg.value_counts(classify.penal(cases(spark, sf_dir)), "grau_certeza")


_OR_MORE, _BETWEEN, _EXACT = r"(\d{1,3})\s*ANOS?\s*OU\s*MAIS", r"(\d{1,3})\s*A\s*(\d{1,3})\s*ANOS?\b", r"^(\d{1,3})\s*ANOS?$"


def _age_sql(e: str, side: str) -> str:
    def n(p, g):
        return f"CAST(regexp_extract({e}, '{p}', {g}) AS INTEGER)"

    pair = f"{'least' if side == 'lo' else 'greatest'}({n(_BETWEEN, 1)}, {n(_BETWEEN, 2)})"
    more = n(_OR_MORE, 1) if side == "lo" else "120"
    return f"CASE WHEN regexp_matches({e}, '{_OR_MORE}') THEN {more} WHEN regexp_matches({e}, '{_BETWEEN}') THEN {pair} WHEN regexp_matches({e}, '{_EXACT}') THEN {n(_EXACT, 1)} WHEN {contains_any(e, config.NEWBORN_TERMS)} THEN 0 END"


_CHILD = f"(coalesce({_age_sql('faixa_etaria_vitima', 'hi')} <= 17, false) OR {contains_any('faixa_etaria_vitima', config.CHILD_TERMS)})"
_ELDER = f"(coalesce({_age_sql('faixa_etaria_vitima', 'lo')} >= 60, false) OR {contains_any('faixa_etaria_vitima', config.ELDERLY_TERMS)})"


@BOOK.add(_CASES + f" SELECT p_partkey, {_age_sql('faixa_etaria_vitima', 'lo')} AS lo, {_age_sql('faixa_etaria_vitima', 'hi')} AS hi, {_CHILD} AS child, {_ELDER} AS elderly FROM c")
def age_bracket(spark, sf_dir):
    rows = tx.with_age(cases(spark, sf_dir), F.col("faixa_etaria_vitima"))
    bracket, age = F.col("_bracket"), F.col("_age")
    return rows.select("p_partkey", age["lo"].alias("lo"), age["hi"].alias("hi"), tx.is_child(bracket, age).alias("child"), tx.is_elderly(bracket, age).alias("elderly"))


_FLAG_SQL = {
    "is_crianca": f"{contains_any('grupo_vulneravel', config.CHILD_TERMS)} OR {_CHILD}",
    "is_mulher": f"contains(grupo_vulneravel, 'MULHER') OR ({contains_any('genero_vitima', config.FEMALE_TERMS)} AND {contains_any('(violacao || motivacao)', config.GENDER_VIOLENCE_TERMS)})",
    "is_idoso": f"{contains_any('grupo_vulneravel', config.ELDERLY_TERMS)} OR {_ELDER}",
    "is_pcd": f"{contains_any('grupo_vulneravel', config.DISABILITY_TERMS)} OR deficiencia_vitima <> ''",
    "is_lgbtqia": f"contains(grupo_vulneravel, 'LGBT') OR {contains_any('orientacao_sexual_vitima', config.LGBT_TERMS)}",
    "is_prisional_rua": f"{contains_any('grupo_vulneravel', config.PRISON_STREET_TERMS)} OR {contains_any('vitima_presa', config.CUSTODY_TERMS)}",
}


@BOOK.add(_CASES + ", f AS (SELECT p_partkey, " + ", ".join(f"CAST(CASE WHEN {e} THEN 1 ELSE 0 END AS BIGINT) AS {n}" for n, e in _FLAG_SQL.items()) + f" FROM c) SELECT *, CASE {' '.join(f'WHEN {n} = 1 THEN {literal(label)}' for n, label in config.PRIMARY.items())} ELSE {literal(config.PRIMARY_OTHER)} END AS grupo_primario, {' + '.join(_FLAG_SQL)} AS qtd_grupos, CAST(CASE WHEN {' + '.join(_FLAG_SQL)} = 0 THEN 1 ELSE 0 END AS BIGINT) AS sem_grupo FROM f")
def group_classifier(spark, sf_dir):
    return classify.groups(cases(spark, sf_dir)).select("p_partkey", *_FLAG_SQL, "grupo_primario", "qtd_grupos", "sem_grupo")


_SIGNALS = {"grupo_vulneravel": "grupo_vulneravel <> ''", "faixa_etaria": f"({_age_sql('faixa_etaria_vitima', 'lo')} IS NOT NULL OR {_CHILD} OR {_ELDER})", "genero": "genero_vitima <> ''", "deficiencia": "deficiencia_vitima <> ''", "orientacao_sexual": "orientacao_sexual_vitima <> ''", "motivacao": "motivacao <> ''", "vitima_presa": "vitima_presa <> ''"}


@BOOK.add(_CASES + ", s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS signal, count_if({e}) AS n FROM c" for n, e in _SIGNALS.items()) + ") SELECT * FROM s WHERE n > 0")
def signal_coverage(spark, sf_dir):
    """Counted in one pass: exploding the signals would let Catalyst push a filter with all their rules below."""
    sums = classify.groups(cases(spark, sf_dir)).agg(*[F.count_if(F.array_contains("sinais", n)).alias(n) for n in _SIGNALS])
    rows = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("n")) for n in _SIGNALS])
    return sums.select(F.explode(rows).alias("r")).select("r.*").filter("n > 0")


@BOOK.add(FACT_SQL + f"SELECT CASE {' '.join(f'WHEN {f} = 1 THEN {literal(config.PRIMARY[f])}' for f in FLAGS)} ELSE {literal(config.PRIMARY_OTHER)} END AS grupo_primario, count(*) AS n FROM fact GROUP BY 1")
def primary_group_counts(spark, sf_dir):
    return agg.value_counts(fact(spark, sf_dir).withColumn("grupo_primario", classify.primary_group()), "grupo_primario")


@BOOK.add("WITH g AS (SELECT p_partkey, " + _pick_sql("grupo_vulneravel") + " FROM part), u AS (SELECT *, upper(trim(grupo_vulneravel)) AS g FROM g) SELECT CASE WHEN grupo_vulneravel IS NULL OR grupo_vulneravel IN ('', 'null') THEN 'outros' " + " ".join(f"WHEN {contains_any('g', terms)} THEN '{n}'" for n, terms in config.TOPICS) + " ELSE 'outros' END AS topic, count(*) AS n FROM u GROUP BY 1")
def topic_labels(spark, sf_dir):
    return agg.value_counts(cases(spark, sf_dir).withColumn("topic", classify.topic(F.col("grupo_vulneravel"))), "topic")


_NOISE = ("N/D", "  Gênero_da  vítima ", "Não informado", "Deficiência relacionada a doença rara ?", "null", "  Água ")


@BOOK.add(f"WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ([{', '.join(map(literal, _NOISE))}])[1 + CAST(floor(p_partkey / 3) AS BIGINT) % 6] ELSE p_name END AS v, p_brand FROM part) SELECT p_partkey, {key_sql('v')} AS name_key, {clean_sql('v')} AS cleaned, concat_ws(' ; ', nullif({clean_sql('v')}, ''), nullif(p_brand, 'Brand#1')) AS joined FROM r")
def text_clean(spark, sf_dir):
    noise = F.element_at(F.array(*map(F.lit, _NOISE)), (F.pmod(F.floor(F.col("p_partkey") / 3), F.lit(6)) + 1).cast("int"))
    v = F.when(F.col("p_partkey") % 3 == 0, noise).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", v.alias("v"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).otherwise("").alias("b"))
    return rows.select("p_partkey", tx.normal_key(F.col("v")).alias("name_key"), tx.clean(F.col("v")).alias("cleaned"), tx.join_filled(tx.clean(F.col("v")), F.col("b")).alias("joined"))


_PLACE = "CASE c_custkey % 6 WHEN 0 THEN lpad(CAST(4200000 + n_nationkey AS VARCHAR), 7, '0') WHEN 1 THEN CAST(4200000 + n_nationkey AS VARCHAR) || ' | ' || n_name WHEN 2 THEN lower(n_name) || ' (sc)' WHEN 3 THEN '12 - ' || n_name WHEN 4 THEN '3550308' ELSE 'NI' END"


@BOOK.add(f"""WITH r AS (SELECT c_custkey, {_PLACE} AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey), d AS (SELECT CAST(4200000 + n_nationkey AS VARCHAR) AS code, n_name, {key_sql('n_name')} AS k, n_regionkey FROM nation),
p AS (SELECT c_custkey, CASE WHEN starts_with(regexp_extract(trim(raw), '^(\\d{{7}})', 1), '42') THEN regexp_extract(trim(raw), '^(\\d{{7}})', 1) END AS own, CASE WHEN raw <> 'NI' THEN {key_sql("trim(regexp_replace(regexp_replace(trim(raw), '(?i)\\s*\\(SC\\)\\s*', ' ', 'g'), '^\\d+\\s*[|/-]\\s*', ''))")} END AS k FROM r),
c AS (SELECT c_custkey, coalesce(own, d.code, '4200000') AS code FROM p LEFT JOIN d USING (k))
SELECT c_custkey, c.code, coalesce(n_name, 'NÃO IDENTIFICADO') AS name, coalesce(CAST(n_regionkey AS VARCHAR), 'OUTRA') AS region FROM c LEFT JOIN d ON c.code = d.code""")
def municipality_resolve(spark, sf_dir):
    """Codes and free names to the dimension; what does not resolve gets the sentinel, and unknown codes keep their own."""
    nations = table(spark, sf_dir, "nation")
    dim = nations.select((F.col("n_nationkey") + 4_200_000).cast("string").alias("code"), "n_name", tx.normal_key(F.col("n_name")).alias("k"), F.col("n_regionkey").cast("string").alias("region"))
    raw = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    code = (F.col("n_nationkey") + 4_200_000).cast("string")
    kind = F.col("c_custkey") % 6
    place = F.when(kind == 0, code).when(kind == 1, F.concat(code, F.lit(" | "), F.col("n_name"))).when(kind == 2, F.concat(F.lower("n_name"), F.lit(" (sc)"))).when(kind == 3, F.concat(F.lit("12 - "), F.col("n_name"))).when(kind == 4, "3550308").otherwise("NI")
    keyed = raw.select("c_custkey", place.alias("raw")).select("c_custkey", tx.municipality_code(F.col("raw")).alias("own"), tx.municipality_key(F.col("raw")).alias("k"))
    coded = keyed.join(dim.select("k", F.col("code").alias("named")), "k", "left").select("c_custkey", F.coalesce("own", "named", F.lit(config.SENTINEL_CODE)).alias("code"))
    meta = dim.select("code", "n_name", "region")
    return coded.join(meta, "code", "left").select("c_custkey", "code", F.coalesce("n_name", F.lit(config.UNKNOWN_NAME)).alias("name"), F.coalesce("region", F.lit(config.OTHER_REGION)).alias("region"))


@BOOK.add("SELECT p_partkey, list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(g, '{p}') THEN '{f}' END" for p, f in config.MODULE_PATTERNS) + "], lambda x: x IS NOT NULL)))[1] AS first_module, len(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(g, '{p}') THEN '{f}' END" for p, f in config.MODULE_PATTERNS) + "], lambda x: x IS NOT NULL))) AS n_modules FROM (SELECT p_partkey, strip_accents(upper(grupo_vulneravel)) AS g FROM (SELECT p_partkey, " + _pick_sql("grupo_vulneravel") + " FROM part))")
def declared_modules(spark, sf_dir):
    found = tx.declared_modules(F.col("grupo_vulneravel"))
    return cases(spark, sf_dir).select("p_partkey", F.get(found, F.lit(0)).alias("first_module"), F.size(found).cast("long").alias("n_modules"))


@BOOK.add("SELECT CASE r_name WHEN 'ASIA' THEN 'Ásia' WHEN 'EUROPE' THEN 'Europa' ELSE r_name END AS label, r_regionkey FROM region")
def label_mapping(spark, sf_dir):
    return table(spark, sf_dir, "region").select(labelled(F.col("r_name"), {"ASIA": "Ásia", "EUROPE": "Europa"}).alias("label"), "r_regionkey")


@BOOK.add("SELECT k, count(*) AS n, CAST(sum(CAST(v AS BIGINT)) AS BIGINT) AS total FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events) GROUP BY ALL")
def nested_json_map(spark, sf_dir):
    return files.json_map(table(spark, sf_dir, "events"), "props", "bigint", "k", "v").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@BOOK.add(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
  coalesce(regexp_extract(url, '^https?://([^/:?#]+)', 1), '') AS host, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS BIGINT) AS n_links FROM pages""")
def page_extract(spark, sf_dir):
    title = tx.collapse(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.coalesce(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1), F.lit("")).alias("host"), F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href=")).cast("long").alias("n_links"))


_ANY_LINK = r"""(?is)<a[^>]+href=["']([^"']+)["']"""


@BOOK.add(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["'']', 1) AS found FROM pages), u AS (SELECT page_id, unnest(found) AS href, generate_subscripts(found, 1) AS nth FROM l),
b AS (SELECT *, regexp_replace(list_extract(string_split(regexp_replace(href, '/view$', ''), '/'), -1), '\.csv$', '') AS base_name FROM u) SELECT page_id, base_name, arg_min(href, nth) AS href FROM b GROUP BY page_id, base_name""")
def page_links(spark, sf_dir):
    return files.links(table(spark, sf_dir, "pages"), pattern=_ANY_LINK)


_VISIBLE = r"regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_FIELDS = {"email": r"([\w\.-]+@[\w\.-]+\.\w+)", "telefone": files.UNIT_PATTERNS["telefone"], "endereco": files.UNIT_PATTERNS["endereco"]}


@BOOK.add(f"WITH t AS (SELECT page_id, {_VISIBLE} AS t FROM pages) SELECT page_id, " + ", ".join(f"trim(regexp_replace(regexp_extract(t, '{p}', 1), '\\s+', ' ', 'g')) AS {n}" for n, p in _FIELDS.items()) + " FROM t")
def page_fields(spark, sf_dir):
    """Mail address, phone and street of every page's visible text, where it has them."""
    return files.page_records(table(spark, sf_dir, "pages"), patterns=_FIELDS)


@BOOK.add("SELECT event_id, event_type || '/' || user_id AS label FROM events WHERE contains(lower(event_type), 'c') OR contains(lower(props), '42')")
def text_search(spark, sf_dir):
    """A literal search over several columns of all rows, without regard to case."""
    rows = table(spark, sf_dir, "events")
    return rows.filter(tx.has_any(F.lower("event_type"), ["c"]) | tx.has_any(F.lower("props"), ["42"])).select("event_id", F.concat_ws("/", "event_type", "user_id").alias("label"))


@BOOK.add("SELECT event_id, user_id FROM events WHERE user_id IN (1, 5, 9, 20, 33)")
def chosen_ids(spark, sf_dir):
    """The rows of chosen users, which is the feature."""
    return table(spark, sf_dir, "events").filter(F.col("user_id").isin(1, 5, 9, 20, 33)).select("event_id", "user_id")


@BOOK.add("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'PCI/SR/NR' || s_suppkey ELSE '' END AS sigla, CASE WHEN s_suppkey % 3 = 0 THEN 'Núcleo Regional' WHEN s_suppkey % 3 = 1 THEN 'Superintendência Regional' ELSE 'Unidade Regional' END AS tipo,
  CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_suppkey % 40 END AS DOUBLE) AS lat, CASE WHEN s_acctbal > 0 AND s_suppkey % 2 = 0 THEN 'Rua ' || s_suppkey WHEN s_suppkey % 5 = 0 THEN 'Av. ' || s_suppkey ELSE '' END AS endereco,
  'Superintendência em ' || s_nationkey AS vinculacao, s_acctbal > 0 AS tem_medicina_legal, s_suppkey % 5 = 0 AS tem_criminalistica, false AS tem_identificacao FROM supplier""")
def facility_dimension(spark, sf_dir):
    """Nested units, with absent services, empty addresses and a manager's name run into the parent unit, as a flat dimension."""
    k = F.col("s_suppkey")

    def service(there, address):
        return F.when(there, F.struct(F.lit(True).alias("disponivel"), F.lit(None).cast("string").alias("nome"), address.alias("endereco"), F.lit(None).cast("string").alias("telefone"), F.lit(None).cast("string").alias("horario")))

    name = F.when(k % 3 == 0, F.concat(F.lit("Núcleo Regional em X – PCI/SR/NR"), k)).when(k % 3 == 1, F.concat(F.lit("Superintendência de "), k)).otherwise(F.concat(F.lit("Posto "), k))
    text = F.lit(None).cast("string")
    raw = table(spark, sf_dir, "supplier").select(
        *[text.alias(c) for c in ("slug", "ibge_code", "rodovia_principal", "url_oficial", "email")], F.lit("X").alias("municipio"), F.when(k % 7 != 0, (k % 40).cast("double")).alias("latitude"), F.lit(1.0).alias("longitude"), name.alias("nome_unidade"),
        F.concat(F.lit("Superintendência em "), "s_nationkey", F.lit(" Perito Silva")).alias("vinculacao"), F.lit("Perito Silva").alias("responsavel"),
        F.struct(service(F.col("s_acctbal") > 0, F.when(k % 2 == 0, F.concat(F.lit("Rua "), k)).otherwise("")).alias("medicina_legal"), service(k % 5 == 0, F.concat(F.lit("Av. "), k)).alias("criminalistica"), service(F.lit(False), text).alias("identificacao")).alias("servicos"),
    )
    return files.facilities(raw).select("sigla", "tipo", "lat", "endereco", "vinculacao", "tem_medicina_legal", "tem_criminalistica", "tem_identificacao")


@BOOK.add("SELECT CAST(n_nationkey AS VARCHAR) AS ibge_code, n_name AS municipio, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 0.5 ELSE n_nationkey + 100.25 END AS km, 'u' || (n_nationkey % 3) AS pci_proxima FROM nation")
def distance_records(spark, sf_dir):
    """One JSON object for each region, whose keys are codes; the older name of the distance serves where the newer is absent."""
    n = F.col("n_nationkey")
    record = F.struct(F.col("n_name").alias("municipio"), F.when(n % 4 == 0, n + 0.5).alias("distancia_pci_km_linha_reta"), (n + 100.25).alias("distancia_pci_km"), F.concat(F.lit("u"), n % 3).alias("pci_proxima"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(n.cast("string"), record)))).alias("j"))
    return files.distances(rows, "j").select("ibge_code", "municipio", "km", "pci_proxima")


@BOOK.add("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'PCI/SR/NR' || s_suppkey ELSE 'NUC' END AS sigla, 'town ' || s_nationkey AS municipio, CAST(s_suppkey % 40 AS DOUBLE) AS lat, 'nr' || s_suppkey || '@pci.gov.br' AS email,
  CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 10 = 0 THEN 'Avenida B ' || s_suppkey ELSE 'Rua A ' || s_suppkey END WHEN s_suppkey % 5 <> 0 THEN 'Praça C' ELSE '' END AS endereco,
  CASE WHEN s_suppkey % 2 = 0 THEN '(48) 3333-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') WHEN s_suppkey % 5 <> 0 THEN '(49) 99999-1234' ELSE '' END AS telefone,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Segunda a Sexta 08h' ELSE '' END AS horario_medicina_legal, s_suppkey % 2 = 0 AS tem_medicina_legal, s_suppkey % 5 <> 0 AS tem_criminalistica, s_suppkey % 7 = 1 AS tem_identificacao FROM supplier""")
def unit_pages(spark, sf_dir):
    """From pages to the facility dimension: a page for each supplier, whose services stand under headings, one of them told twice."""
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Núcleo Regional de Polícia Científica em X – PCI/SR/NR"), k)).otherwise("Núcleo Regional de Polícia Científica em X")
    legal = F.concat(F.lit("<section><h3>Medicina Legal</h3>\n<p>Rua A "), k, F.lit(" (térreo)</p>\n<p>(48) 3333-"), F.lpad((k % 10_000).cast("string"), 4, "0"), F.lit("</p>\nSegunda a Sexta 08h\n</section>"))
    again = F.concat(F.lit("<section>MEDICINA LEGAL<br>Avenida B "), k, F.lit(" (novo)</section>"))
    crime = F.lit("<div><b>Criminalística</b> Praça C (fundos) Tel. (49) 99999-1234</div>")
    ident = F.lit("<article>IDENTIFICAÇÃO civil</article>")
    html = F.concat(
        F.lit("<html><script>var x = 'MEDICINA LEGAL';</script><h1>"), name, F.lit("</h1>\n<p>Perito Regional Fulano</p>\n<p>nr"), k, F.lit("@pci.gov.br</p>\n"),
        F.when(k % 2 == 0, legal).otherwise(""), F.when(k % 5 != 0, crime).otherwise(""), F.when(k % 7 == 1, ident).otherwise(""), F.when(k % 10 == 0, again).otherwise(""), F.lit("</html>"),
    )
    pages = table(spark, sf_dir, "supplier").select(k.alias("page_id"), html.alias("html"), F.concat(F.lit("town "), "s_nationkey").alias("municipio"), (k % 40).cast("double").alias("latitude"))
    found = files.facilities(files.page_units(pages))
    return found.select(F.when(F.col("sigla").startswith("PCI"), F.col("sigla")).otherwise("NUC").alias("sigla"), "municipio", "lat", "email", "endereco", "telefone", "horario_medicina_legal", "tem_medicina_legal", "tem_criminalistica", "tem_identificacao")


@BOOK.add("""WITH v AS (SELECT regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT count(*) AS pages, CAST(sum(len(regexp_extract_all(t, '(?i)nicht|the '))) + count(*) AS BIGINT) AS parts, CAST(sum(len(regexp_extract_all(t, '(?i)nicht'))) AS BIGINT) AS nicht, CAST(sum(length(t)) AS BIGINT) AS characters FROM v""")
def page_parts(spark, sf_dir):
    """All pages cut at two words: parts, those of one word, and all their characters, of which none is lost."""
    parts = files.page_sections(table(spark, sf_dir, "pages"), headings={"nicht": "NICHT", "the": "THE "})
    return parts.agg(F.count_if(F.col("nth") == 0).alias("pages"), F.count(F.lit(1)).alias("parts"), F.count_if(F.col("service") == "nicht").alias("nicht"), F.sum(F.length("body")).alias("characters"))
