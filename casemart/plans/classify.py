"""Record classifiers: the penal taxonomy, reinforcement signals, group flags, topics. All of it is one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as tx


#: Every verdict, the taxonomy first; a record's verdict is a number in this list until its columns are read off.
VERDICTS = (*config.TAXONOMY, config.PSYCHOLOGICAL_ELDERLY, config.PSYCHOLOGICAL_WOMAN, config.REINFORCED, config.SOCIAL)
ELDERLY, WOMAN, REINFORCED, SOCIAL = range(len(config.TAXONOMY), len(VERDICTS))


def first_match(text: Column, rules=config.TAXONOMY) -> Column:
    """The number of the first rule with a term in the text, else null. The order of the rules decides."""
    chain = F
    for n, r in enumerate(rules):
        chain = chain.when(tx.has_any(text, r.terms), F.lit(n))
    return chain.otherwise(F.lit(None))


def of_verdict(number: Column, field: str) -> Column:
    return F.get(F.array(*[F.lit(getattr(v, field)) for v in VERDICTS]), number)


def reinforcement(field) -> Column:
    """The first reinforcement signal; field(name) gives the cleaned value of a canonical field."""
    chain = F
    for fields, words, reason in config.REINFORCEMENT:
        for name in fields:
            chain = chain.when(tx.has_any(field(name), words), F.lit(reason))
    return chain.otherwise(F.lit(config.NO_REINFORCEMENT))


#: Canonical fields that `penal` and `groups` read.
PENAL_FIELDS = tuple(sorted({*config.TEXT_FIELDS, *(n for fields, _, _ in config.REINFORCEMENT for n in fields), "genero_vitima"}))
GROUP_FIELDS = ("grupo_vulneravel", "genero_vitima", "deficiencia_vitima", "orientacao_sexual_vitima", "vitima_presa", "violacao", "subgrupo_violacao", "motivacao", "relacao_vitima_suspeito")
AGE_FIELD = "faixa_etaria_vitima"


def penal(df: DataFrame) -> DataFrame:
    """Adds texto_caso, motivo_reforco and the verdict's columns to rows with canonical fields.

    The cleaned fields are columns of their own, so each is computed once. A
    caller that filters on the verdict should write or persist the result
    first: Catalyst would push the filter, with all rules, below.
    """
    names = PENAL_FIELDS
    cleaned = df.withColumns({f"_{n}": tx.clean(F.col(n)) if n in df.columns else F.lit("") for n in names})

    def field(name: str) -> Column:
        return F.col(f"_{name}")

    cleaned = cleaned.withColumn("texto_caso", tx.join_filled(*map(field, config.TEXT_FIELDS))).withColumn("motivo_reforco", reinforcement(field))
    text, group, gender = F.col("texto_caso"), field("grupo_vulneravel"), field("genero_vitima")
    psychological = tx.has_any(text, config.PSYCHOLOGICAL_TERMS)
    reinforced = F.col("motivo_reforco") != config.NO_REINFORCEMENT
    decided = F.coalesce(
        first_match(text),
        F.when(psychological & tx.has_any(group, ("IDOSA", "IDOSO")), ELDERLY),
        F.when(psychological & (group.contains("MULHER") | gender.contains("FEMIN") | (gender == "F")), WOMAN),
        F.when(reinforced, REINFORCED),
        F.lit(SOCIAL),
    )
    n = F.col("_verdict")
    category = of_verdict(n, "category")
    columns = {
        "indicio_penal": (n != SOCIAL).cast("long"),
        "indicio_penal_texto": (n < REINFORCED).cast("long"),
        "categoria_penal": F.when(n == REINFORCED, F.concat(category, F.col("motivo_reforco"))).otherwise(category),
        "grau_certeza": of_verdict(n, "degree"),
        "fundamentacao_legal": of_verdict(n, "articles"),
        "orgao_prioritario": of_verdict(n, "agency"),
    }
    done = cleaned.withColumn("_verdict", decided).withColumns(columns)
    return done.withColumn("indicio_penal_reforco", reinforced.cast("long")).drop("_verdict", *[f"_{n}" for n in names])


def groups(df: DataFrame) -> DataFrame:
    """Adds the six group flags (0/1, not exclusive), grupo_primario, sem_grupo, qtd_grupos and sinais (the signals at hand)."""

    def raw(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    fields = GROUP_FIELDS
    c = tx.with_age(df.withColumns({f"_{n}": tx.clean(raw(n)) for n in fields}), raw(AGE_FIELD))
    group, bracket, age = F.col("_grupo_vulneravel"), F.col("_bracket"), F.col("_age")
    context = F.concat_ws(" ; ", tx.join_filled(F.col("_violacao"), F.col("_subgrupo_violacao")), tx.join_filled(F.col("_motivacao"), F.col("_relacao_vitima_suspeito")))
    flags = {
        "is_crianca": tx.has_any(group, config.CHILD_TERMS) | tx.is_child(bracket, age),
        "is_mulher": group.contains("MULHER") | (tx.has_any(F.col("_genero_vitima"), config.FEMALE_TERMS) & tx.has_any(context, config.GENDER_VIOLENCE_TERMS)),
        "is_idoso": tx.has_any(group, config.ELDERLY_TERMS) | tx.is_elderly(bracket, age),
        "is_pcd": tx.has_any(group, config.DISABILITY_TERMS) | (F.col("_deficiencia_vitima") != ""),
        "is_lgbtqia": group.contains("LGBT") | tx.has_any(F.col("_orientacao_sexual_vitima"), config.LGBT_TERMS),
        "is_prisional_rua": tx.has_any(group, config.PRISON_STREET_TERMS) | tx.has_any(F.col("_vitima_presa"), config.CUSTODY_TERMS),
    }
    c = c.withColumns({n: e.cast("long") for n, e in flags.items()})
    signals = {
        "grupo_vulneravel": group != "",
        "faixa_etaria": age.isNotNull() | tx.is_child(bracket, age) | tx.is_elderly(bracket, age),
        "genero": F.col("_genero_vitima") != "",
        "deficiencia": F.col("_deficiencia_vitima") != "",
        "orientacao_sexual": F.col("_orientacao_sexual_vitima") != "",
        "motivacao": F.col("_motivacao") != "",
        "vitima_presa": F.col("_vitima_presa") != "",
    }
    c = c.withColumn("sinais", F.array_compact(F.array(*[F.when(e, F.lit(n)) for n, e in signals.items()])))
    return with_group_counts(c.withColumn("grupo_primario", primary_group())).drop("_bracket", "_age", *[f"_{n}" for n in fields])


def primary_group(labels: dict[str, str] = config.PRIMARY, other: str = config.PRIMARY_OTHER) -> Column:
    """The label of the first flag that is set, in the order of `labels`."""
    chain = F
    for flag, label in labels.items():
        chain = chain.when(F.col(flag) == 1, F.lit(label))
    return chain.otherwise(F.lit(other))


def with_group_counts(df: DataFrame, flags=tuple(config.GROUPS.values())) -> DataFrame:
    n = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return df.withColumn("qtd_grupos", n).withColumn("sem_grupo", (F.col("qtd_grupos") == 0).cast("long"))


def topic(raw: Column) -> Column:
    """One topic per raw group label, by its own order of terms."""
    label = F.upper(F.btrim(raw))
    chain = F.when(raw.isNull() | (raw == "") | (raw == "null"), config.TOPIC_OTHER)
    for name, terms in config.TOPICS:
        chain = chain.when(tx.has_any(label, terms), F.lit(name))
    return chain.otherwise(F.lit(config.TOPIC_OTHER))


def reliable(id_column: Column, value: Column) -> Column:
    """1 where the id is a true complaint id: the column that holds it is the complaint hash and the value is not empty."""
    return F.coalesce((tx.normal_key(id_column) == "hash") & (value != ""), F.lit(False)).cast("long")


#: What a batch's summary shows, and how many values of each at most.
SUMMED = {"grau_certeza": None, "categoria_penal": 10, "orgao_prioritario": 5}


def summary(classified: DataFrame, tops: dict[str, int | None] = SUMMED) -> DataFrame:
    """field, position, value, n, share of a classified batch: all, penal and social records, then the most frequent values of each field.

    One aggregate over the fields' values; equal counts go by value. An empty
    batch has three rows of 0 without a share.
    """
    kinds = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in tops])
    counts = classified.select(F.inline(kinds)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), F.asc_nulls_last("value")))  # a row for each value
    limits = F.create_map(*[F.lit(x) for c, n in tops.items() for x in (c, n or 2**31 - 1)])
    ranked = counts.withColumn("position", nth).filter(F.col("position") <= limits[F.col("field")])
    penal = F.coalesce(F.sum("indicio_penal"), F.lit(0))
    totals = classified.agg(F.count(F.lit(1)).alias("records"), penal.alias("penal"))
    rows = F.array(*[F.struct(F.lit("registros").alias("field"), F.lit(k).alias("position"), F.lit(v).alias("value"), n.alias("n")) for k, (v, n) in enumerate((("total", F.col("records")), ("penal", F.col("penal")), ("social", F.col("records") - F.col("penal"))), 1)])
    whole = totals.select(F.inline(rows)).unionByName(ranked)
    return whole.crossJoin(F.broadcast(totals)).select("field", "position", "value", "n", F.when(F.col("records") > 0, F.round(100 * F.col("n") / F.col("records"), 1)).alias("share"))


