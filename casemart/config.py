"""Fixed values of the case-report model: spellings, word lists, rules, limits."""

from __future__ import annotations

from dataclasses import dataclass

# What counts as no information, after `functions.text.normal_key`.
NULL_TOKENS = (
    "", "nan", "null", "none", "na", "n_a", "n_d", "nd", "ni",
    "nao", "sim_nao", "vazio", "ignorado", "indefinido",
    "nao_tem_deficiencia", "sem_deficiencia", "nao_possui",
    "sem_informacao", "atendimento_interrompido",
)
NULL_PREFIXES = (
    "nao_informad", "nao_identificad", "nao_declarad", "nao_soube",
    "nao_se_aplica", "denunciante_nao_soube", "sem_informac",
)
CSV_NULLS = ("NULL", "null", "None", "NA", "N/A", "N/D", "")

# Canonical field -> accepted spellings, in the order of preference.
ALIASES = {
    "id_denuncia": ("hash", "hash_par_vitima_suspeito"),
    "uf": ("UF", "vitima_uf", "UF da vítima", "Estado"),
    "municipio": ("vitima_cod_municipio", "Município", "Município da vítima", "vitima_municipio", "sl_vitima_naturalizado_municipio"),
    "data_cadastro": ("Data de cadastro", "Data da denúncia", "data_atendimento"),
    "grupo_vulneravel": ("Grupo vulnerável", "grupo_violacao"),
    "subgrupo_violacao": ("sub_grupo_violacao",),
    "genero_vitima": ("Gênero da vítima", "Genero da vítima", "Sexo da vítima", "vitima_sexo"),
    "faixa_etaria_vitima": ("Faixa etária da vítima", "vitima_faixa_etaria", "idade_vitima"),
    "deficiencia_vitima": ("Deficiência da vítima", "deficiencia_vitima"),
    "orientacao_sexual_vitima": ("Orientação sexual da vítima", "vitima_orientacao_sexual", "orientacao_sexual"),
    "vitima_presa": ("Vítima preso(a)", "Vítima preso a"),
    "violacao": ("violacao", "violacoes"),
    "motivacao": ("Motivação", "motivacoes", "relacao_suspeito"),
    "relacao_vitima_suspeito": ("Relação vítima-suspeito", "Relação Suspeito x Vítima", "relacao_suspeito"),
    "cenario_violacao": ("Cenário da violação", "cenario_local", "cenario_ocorrencia"),
    "denuncia_emergencial": ("Denúncia emergencial", "Denúncia Emergencial"),
    "suspeito_preso": ("Suspeito preso",),
}

TEXT_FIELDS = ("violacao", "subgrupo_violacao", "grupo_vulneravel", "motivacao")


@dataclass(frozen=True)
class Rule:
    """One entry of the penal taxonomy. The first rule with a term in the text decides."""

    category: str
    degree: str
    articles: str
    agency: str
    terms: tuple[str, ...] = ()


# The penal taxonomy, in order.
TAXONOMY = (
    Rule("CRIMES_CONTRA_A_VIDA", "ALTO", "Arts. 121, 122, 124-126 do Código Penal", "DELEGACIA_DE_HOMICIDIOS_OU_POLICIA_CIVIL", (
        "HOMICÍDIO", "HOMICIDIO", "FEMINICÍDIO", "FEMINICIDIO",
        "INCITAÇÃO AO SUICÍDIO", "INCITACAO AO SUICIDIO", "INDUZIMENTO AO SUICÍDIO",
        "GENOCÍDIO", "GENOCIDIO", "ABORTO", "TENTATIVA DE HOMICÍDIO")),
    Rule("CRIMES_SEXUAIS", "ALTO", "Arts. 213, 215-A, 216-A, 217-A, 218-B do CP; Arts. 240, 241, 244-A do ECA", "DELEGACIA_ESPECIALIZADA_E_POLICIA_CIENTIFICA", (
        "ESTUPRO", "ESTUPRO DE VULNERÁVEL", "ESTUPRO VIRTUAL", "ESTUPRO CORRETIVO",
        "ABUSO SEXUAL", "IMPORTUNAÇÃO SEXUAL", "IMPORTUNACAO SEXUAL",
        "ASSÉDIO SEXUAL", "ASSEDIO SEXUAL", "PEDOFILIA", "PORNOGRAFIA INFANTIL",
        "EXPLORAÇÃO SEXUAL", "EXPLORACAO SEXUAL", "LASCÍVIA", "LASCIVIA",
        "VIOLÊNCIA SEXUAL MEDIANTE FRAUDE", "VIOLENCIA SEXUAL")),
    Rule("CRIMES_INTEGRIDADE_FISICA_E_TORTURA", "ALTO", "Lei 9.455/97 (Tortura); Arts. 129, 132, 136 CP; Lei 14.344/22; Art. 21 LCP", "POLICIA_CIVIL_E_POLICIA_CIENTIFICA", (
        "TORTURA FÍSICA", "TORTURA FISICA", "TORTURA PSÍQUICA", "TORTURA PSIQUICA", "TORTURA",
        "LESÃO CORPORAL", "LESAO CORPORAL", "MAUS TRATOS", "MAUS-TRATOS",
        "AGRESSÃO", "AGRESSAO", "VIAS DE FATO", "EXPOSIÇÃO DE RISCO À SAÚDE",
        "EXPOSICAO DE RISCO A SAUDE", "PERIGO PARA A VIDA OU SAÚDE")),
    Rule("CRIMES_CONTRA_A_LIBERDADE_INDIVIDUAL", "ALTO", "Arts. 147-A, 148, 149, 149-A do CP; Art. 239 do ECA; Lei 11.343/06", "POLICIA_CIVIL_OU_FEDERAL", (
        "CÁRCERE PRIVADO", "CARCERE PRIVADO", "SEQUESTRO", "EXTORSÃO MEDIANTE SEQUESTRO",
        "CONDIÇÃO ANÁLOGA À DE ESCRAVO", "CONDICAO ANALOGA", "TRABALHO ESCRAVO",
        "TRÁFICO DE PESSOAS", "TRAFICO DE PESSOAS", "TRÁFICO DE CRIANÇAS", "TRAFICO DE CRIANCAS",
        "TRÁFICO DE MULHERES", "TRÁFICO DE DROGAS", "TRAFICO DE DROGAS",
        "ALICIAMENTO PARA O TRÁFICO", "STALKING", "PERSEGUIÇÃO", "PERSEGUICAO")),
    Rule("CRIMES_DE_AMEACA_E_COACAO", "MEDIO", "Arts. 146, 147, 158, 344 do Código Penal", "DELEGACIA_DE_POLICIA_CIVIL", (
        "AMEAÇA", "AMEACA", "COAÇÃO", "COACAO", "CONSTRANGIMENTO",
        "EXTORSÃO", "EXTORSAO", "CHANTAGEM")),
    Rule("CRIMES_CONTRA_A_HONRA_E_PRECONCEITO", "MEDIO", "Arts. 138-140 do CP; Lei 7.716/89 (Racismo e Injúria Racial); STF ADO 26", "DELEGACIA_DE_POLICIA_E_MINISTERIO_PUBLICO", (
        "INJÚRIA RACIAL", "INJURIA RACIAL", "RACISMO", "CALÚNIA", "CALUNIA",
        "DIFAMAÇÃO", "DIFAMACAO", "INJÚRIA", "INJURIA", "HOMOFOBIA", "TRANSFOBIA")),
    Rule("CRIMES_PATRIMONIAIS_E_FINANCEIROS", "MEDIO", "Arts. 155, 168, 171 CP; Arts. 102, 104 da Lei 10.741/03; Art. 89 Lei 13.146/15", "DELEGACIA_DE_POLICIA_E_MINISTERIO_PUBLICO", (
        "APROPRIAÇÃO DE BENS", "APROPRIACAO DE BENS", "EXPROPRIAÇÃO", "EXPROPRIACAO",
        "RETENÇÃO DE SALÁRIO", "RETENCAO DE SALARIO", "RETENÇÃO DE CARTÃO", "RETENCAO DE CARTAO",
        "PATRIMONIAL>INDIVIDUAL", "VIOLÊNCIA PATRIMONIAL", "VIOLENCIA PATRIMONIAL",
        "ABUSO FINANCEIRO")),
    Rule("CRIMES_DE_ABANDONO_E_OMISSAO", "MEDIO", "Arts. 133, 135, 244 do CP; Art. 98 da Lei 10.741/03 (Estatuto do Idoso)", "MINISTERIO_PUBLICO_E_CONSELHO_TUTELAR", (
        "ABANDONO DE INCAPAZ", "ABANDONO MATERIAL", "ABANDONO DE IDOSO",
        "FÍSICA>ABANDONO", "FISICA>ABANDONO", "NEGLIGÊNCIA.ABANDONO", "OMISSÃO DE SOCORRO")),
)

# Reinforcement signals, in order: field(s), words, reason.
REINFORCEMENT = (
    (("denuncia_emergencial",), ("RISCO IMINENTE", "FLAGRANTE", "SANGRAMENTO", "EMERGÊNCI", "EMERGENCI", "IMINENTE"), "FLAGRANTE_OU_RISCO_IMINENTE"),
    (("cenario_violacao",), ("DELEGACIA", "PRESÍDIO", "PRESIDIO", "PENITENCIÁR", "PENITENCIAR", "CADEIA", "CUSTÓDIA", "CUSTODIA"), "CENARIO_POLICIAL_OU_PRISIONAL"),
    (("suspeito_preso", "vitima_presa"), (
        "RECLUS", "TEMPORÁRI", "TEMPORARI", "PREVENTIV", "FLAGRANTE", "SEMI-ABERTO", "SEMIABERTO",
        "PRISÃO", "PRISAO", "PENA", "SOCIOEDUCATIV", "REGIME"), "CUSTODIA_PRISIONAL_ATIVA"),
)
NO_REINFORCEMENT = "SEM_REFORCO_FATICO"
PSYCHOLOGICAL_TERMS = ("HUMILHAÇÃO", "HUMILHACAO", "HOSTILIZAÇÃO", "HOSTILIZACAO", "VIOLÊNCIA PSICOLÓGICA", "VIOLENCIA PSICOLOGICA")
PSYCHOLOGICAL_ELDERLY = Rule("VIOLENCIA_PSICOLOGICA_CONTRA_IDOSO", "MEDIO", "Arts. 96 e 99 da Lei 10.741/03 (Estatuto da Pessoa Idosa)", "DELEGACIA_DE_POLICIA_E_MINISTERIO_PUBLICO")
PSYCHOLOGICAL_WOMAN = Rule("VIOLENCIA_PSICOLOGICA_CONTRA_MULHER", "MEDIO", "Art. 147-B do Código Penal (Lei 14.188/21 - Violência Psicológica)", "DELEGACIA_DA_MULHER_DPCAMI")
REINFORCED = Rule("INFRACAO_PENAL_REFUGIO_", "ALTO", "Notícia de Flagrante Delito, Risco Iminente ou Procedimento Prisional Ativo", "POLICIA_CIVIL_OU_MILITAR")
SOCIAL = Rule("REDE_DE_PROTECAO_SOCIAL", "BAIXO", "Demanda Assistencial, Cível ou Administrativa (Sem tipicidade penal primária)", "REDE_SOCIOASSISTENCIAL_CRAS_CREAS_E_CONSELHO")

# The six groups, their flags, their primary labels by priority.
CHILD_MAX_AGE, ELDERLY_MIN_AGE, OPEN_AGE = 17, 60, 120
GROUPS = {"criancas": "is_crianca", "mulheres": "is_mulher", "idosos": "is_idoso", "pcd": "is_pcd", "lgbt": "is_lgbtqia", "prisional": "is_prisional_rua"}
PRIMARY = {
    "is_crianca": "CRIANCAS_E_ADOLESCENTES", "is_mulher": "MULHERES_VIOLENCIA_GENERO", "is_idoso": "PESSOAS_IDOSAS",
    "is_pcd": "PESSOAS_COM_DEFICIENCIA", "is_lgbtqia": "POPULACAO_LGBTQIA+", "is_prisional_rua": "SISTEMA_PRISIONAL_E_RUA",
}
PRIMARY_OTHER = "GERAL_OUTROS"
NEWBORN_TERMS = ("RECEM", "NASCITURO", "NASCIDO", "MENOR DE IDADE")
CHILD_TERMS = ("CRIANCA", "CRIANÇA", "ADOLESC")
ELDERLY_TERMS = ("IDOS",)
FEMALE_TERMS = ("FEMIN", "MULHER")
GENDER_VIOLENCE_TERMS = (
    "DOMESTICA", "DOMÉSTICA", "CONJUGAL", "MARIA DA PENHA", "COMPANHEIR", "NAMORAD", "CONJUGE", "CÔNJUGE",
    "FEMINICIDIO", "FEMINICÍDIO", "147-B", "EX-MARIDO", "EX-COMPANHEIRO", "VIOLENCIA DE GENERO",
)
DISABILITY_TERMS = ("DEFICIENCIA", "DEFICIÊNCIA")
LGBT_TERMS = ("HOMO", "LESB", "LÉSB", "GAY", "BISSEX", "TRANS", "TRAVEST", "NAO BINARI", "NÃO BINÁRI", "QUEER", "ASSEXU", "PANSSEX")
PRISON_STREET_TERMS = ("LIBERDADE", "PRISIONAL", "PRESIDIO", "PRESÍDIO", "RUA", "ENCARCERAD")
CUSTODY_TERMS = (
    "SIM", "PRESO", "PRESA", "PENA", "RECLUS", "SEMI-ABERTO", "SEMIABERTO", "PROVISORI", "PROVISÓRI",
    "PREVENTIV", "TEMPORARI", "TEMPORÁRI", "FLAGRANTE", "SOCIOEDUCATIV", "REGIME",
)
MODULE_PATTERNS = (
    ("CRIANC", "is_crianca"), ("ADOLESC", "is_crianca"), ("MULHER", "is_mulher"), ("IDOS", "is_idoso"),
    ("DEFICIENCIA", "is_pcd"), ("LGBT", "is_lgbtqia"), ("LIBERDADE", "is_prisional_rua"), ("RUA", "is_prisional_rua"),
)

# The single-label topics, in order.
TOPICS = (
    ("lgbt", ("LGBT", "GÊNERO", "SEXUAL", "TRANS", "HOMOFOB")),
    ("rua", ("RUA", "DESABRIGAD")),
    ("mulher", ("MULHER", "FEMIN")),
    ("crianca", ("CRIAN", "ADOLESC", "INFÂN")),
    ("idoso", ("IDOSA", "IDOSO", "TERCEIRA IDADE")),
    ("pcd", ("DEFICI", "PCD", "ACF")),
    ("preso", ("LIBERDADE", "PRISION", "CÁRCERE", "PRESO")),
    ("racial", ("RACIAL", "NEGRO", "INDÍGEN", "QUILOMB", "CIGANO", "ÉTNIC")),
)
TOPIC_OTHER = "outros"

# Territory and rates.
STATE, CODE_PREFIX, SENTINEL_CODE = "SC", "42", "4200000"
UNKNOWN_NAME, OTHER_REGION = "NÃO IDENTIFICADO", "OUTRA"
EARTH_KM, ROAD_FACTOR = 6371.0, 1.4
NEAR_KM, FAR_KM = 25, 50
RATE_SCALE, RATE_FLOOR, LEGACY_YEARS = 10_000, 20_000, 16
FALLBACK_POINT = (-27.24, -50.21)
