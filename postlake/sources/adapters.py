"""Postings, preferences and events derived from the supplied tables.

The tables hold no postings, so these are derived from documents and events by rules on
their ids. The derivations are SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

# Pools that postings are drawn from, by doc_id.
TITLES = [
    "Estágio em Desenvolvimento Python", "Desenvolvedor Python Júnior", "Desenvolvedor Java Sênior", "Engenheiro de Software Pleno",
    "Atendente de Loja", "Analista de Dados", "Estagiário de TI", "Head of Engineering", "Pessoa Desenvolvedora Backend", "Tech Lead",
    "Vendedora", "UX Designer", "DevOps Engineer (Cloud)", "QA", "Diretor de Tecnologia", "Programador Django  Pleno", "[Teste] Vaga",
    "Разработчик Python", "Бухгалтер", "ソフトウェア エンジニア", "백엔드 개발자", "Entwickler für München-Süd", "Estagiari@ de TI",
]
COMPANIES = ["Acme Ltda", "ACME Tecnologia S/A", "Grupo Beta Soluções", "Beta", "Gama Inc", "Empresa Alpha", "", "Delta Sistemas", "Delta Sistemas Brasil", "Épsilon Serviços ME", "Banco Zeta", "Яндекс", "Straße Łódź Inc", "株式会社アクメ", "삼성전자", "Ελλάδα ΜΕme Brasil", "Сбер"]
LOCATIONS = ["São Paulo, SP", "Remoto", "Rio de Janeiro - RJ", "Híbrido / Curitiba", "Austin, Texas", "Santiago, Chile", "", "Belo Horizonte, Minas Gerais", "Remote (anywhere)", "Москва", "Казань", "München", "東京", "São Paulo/Ñsp"]
MODES = ["remote", "hybrid", "onsite", "", "remoto", "presencial"]
LEVELS = ["", "junior", "senior", "mid", "estagio"]
TYPES = ["clt", "pj", "estagio", "internship", "", "full_time", "temporário"]
PHRASES = [
    "Trabalhe com Python e Django em APIs REST.", "Vaga encerrada.", "Buscamos quem conheça SQL, git e Docker.", "Ganhe dinheiro fácil!",
    "Atendimento ao público.", "This position has been closed.", "Cloud, Linux e dados.", "Marketing multinível, renda extra garantida.", "Equipe remota.", "Front-end com React.",
]
SKILLS = ["Python,Django,SQL", "Java,Spring", "", "Python", "React,Docker,git", "Excel"]


def _pool(values: list[str], index: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE CAST({index} AS INT) {whens} END"


_POSTINGS = f"""
SELECT doc_id AS posting_seq,
  CASE WHEN doc_id % 3 = 0 THEN concat('E', CAST((doc_id % 97) * 3 AS STRING)) ELSE '' END AS external_id,
  concat('src', CAST(doc_id % 13 AS STRING)) AS source,
  CASE WHEN doc_id % 41 = 0 THEN 'ftp://old' WHEN doc_id % 29 = 3 THEN '' ELSE concat('https://', CASE WHEN doc_id % 2 = 0 THEN 'Jobs' ELSE 'jobs' END, '.Example.com/v', CAST(doc_id % 701 AS STRING),
    CASE WHEN doc_id % 5 = 0 THEN '/' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN '?utm_source=x#top' ELSE '' END) END AS url,
  {_pool(TITLES, f"doc_id % {len(TITLES)}")} AS title,
  {_pool(COMPANIES, f"doc_id % {len(COMPANIES)}")} AS company,
  {_pool(LOCATIONS, f"doc_id % {len(LOCATIONS)}")} AS location,
  {_pool(MODES, f"doc_id % {len(MODES)}")} AS work_mode,
  {_pool(LEVELS, f"doc_id % {len(LEVELS)}")} AS seniority,
  {_pool(TYPES, f"doc_id % {len(TYPES)}")} AS employment_type,
  concat({_pool(PHRASES, f"doc_id % {len(PHRASES)}")}, ' ', coalesce(text, '')) AS description,
  {_pool(SKILLS, f"doc_id % {len(SKILLS)}")} AS skills_text,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(1000 + doc_id % 6000 AS DOUBLE) END AS salary_min,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(2000 + doc_id % 9000 AS DOUBLE) END AS salary_max,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST('{AS_OF}' AS TIMESTAMP) - CAST(doc_id % 90 AS INT) * INTERVAL '1' DAY - CAST(doc_id % 24 AS INT) * INTERVAL '1' HOUR END AS published_at,
  CAST('{AS_OF}' AS TIMESTAMP) - CAST(doc_id % 80 AS INT) * INTERVAL '1' DAY AS discovered_at
FROM {{documents}}
"""

_EARLIER = """
SELECT posting_seq, external_id, source, url, title, company,
  CASE WHEN posting_seq % 6 = 1 THEN 'Recife' ELSE location END AS location,
  CASE WHEN posting_seq % 5 = 2 THEN 'hybrid' ELSE work_mode END AS work_mode,
  CASE WHEN posting_seq % 3 = 1 THEN salary_min + 250 ELSE salary_min END AS salary_min,
  CASE WHEN posting_seq % 8 = 3 THEN NULL ELSE salary_max END AS salary_max,
  CASE WHEN posting_seq % 9 = 4 THEN substr(description, 1, 60) ELSE description END AS description,
  CASE WHEN posting_seq % 10 = 5 THEN 'closed' ELSE 'active' END AS status,
  CASE WHEN posting_seq % 12 = 6 THEN published_at - INTERVAL '2' DAY ELSE published_at END AS published_at
FROM ({postings}) p WHERE posting_seq % 4 <> 3
"""

# Profiles with preferences: an entry-level back end, a mid front end, a senior data one, and one without wishes.
PROFILES = [
    dict(profile_id=1, roles=["Desenvolvedor Python"], skills=["Python", "Django", "SQL"], profile_seniority="junior", desired_roles=["Estágio em TI", "Desenvolvedor"],
         preferred_keywords=["api"], mandatory_keywords=[], excluded_keywords=["vendedora", "java"], excluded_companies=["Banco Zeta"], work_modes=["remote", "hybrid"],
         locations=["São Paulo, SP", "Remoto"], employment_types=["estagio", "clt"], seniority_levels=["estagio", "junior"], minimum_salary=1500.0, maximum_salary=None, excluded_postings=[1, 5, 22, 104], minimum_match_score=60),
    dict(profile_id=2, roles=["Frontend Developer"], skills=["React", "Docker"], profile_seniority="mid", desired_roles=["UX Designer"], preferred_keywords=[],
         mandatory_keywords=["react", "docker"], excluded_keywords=[], excluded_companies=["acme"], work_modes=[], locations=["Curitiba", "Brasil"],
         employment_types=["pj"], seniority_levels=["mid", "senior"], minimum_salary=None, maximum_salary=5000.0, excluded_postings=[], minimum_match_score=None),
    dict(profile_id=3, roles=["Analista de Dados"], skills=["Python", "SQL", "Linux"], profile_seniority="senior", desired_roles=["dados"], preferred_keywords=["cloud"],
         mandatory_keywords=[], excluded_keywords=["renda extra"], excluded_companies=[], work_modes=["onsite"], locations=["Santiago, Chile"], employment_types=[],
         seniority_levels=["senior"], minimum_salary=4000.0, maximum_salary=9000.0, excluded_postings=[3], minimum_match_score=55),
    dict(profile_id=4, roles=[], skills=[], profile_seniority="", desired_roles=[], preferred_keywords=[], mandatory_keywords=[], excluded_keywords=[], excluded_companies=[],
         work_modes=[], locations=[], employment_types=[], seniority_levels=[], minimum_salary=None, maximum_salary=None, excluded_postings=[], minimum_match_score=0),
]
_TYPES = {"profile_id": "int", "minimum_match_score": "int", "profile_seniority": "string", "minimum_salary": "double", "maximum_salary": "double", "excluded_postings": "array<bigint>"}


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(_POSTINGS, documents=table(spark, sf_dir, "documents"))
    return df.withColumn("requirements", F.array_remove(F.split("skills_text", ","), "")).drop("skills_text")


def earlier_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A former version of three quarters of the postings, with some fields changed."""
    return spark.sql(_EARLIER.replace("({postings}) p", "{postings}"), postings=postings(spark, sf_dir))


def profiles(spark: SparkSession) -> DataFrame:
    """The profiles with their preferences: as many rows as PROFILES."""
    schema = ", ".join(f"{k} {_TYPES.get(k, 'array<string>')}" for k in PROFILES[0])
    return spark.createDataFrame([tuple(p.values()) for p in PROFILES], schema)


#: Tables of profiles of up to this many rows (a few kilobytes each) are broadcast.
BROADCAST_PROFILES = 10_000


def small(df: DataFrame, rows: int = BROADCAST_PROFILES) -> DataFrame:
    """The table, to be broadcast if it has at most ``rows`` rows; a larger one joins as Spark sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings_sql() -> str:
    inner = _POSTINGS.format(documents="documents")
    return f"SELECT * EXCLUDE (skills_text), list_filter(string_split(skills_text, ','), lambda x: x <> '') AS requirements FROM ({inner}) q"


def earlier_sql() -> str:
    return _EARLIER.format(postings=postings_sql())


def profiles_sql() -> str:
    def lit(k: str, v) -> str:
        if k == "excluded_postings":
            return f"CAST({v} AS BIGINT[])"
        if isinstance(v, list):
            return "CAST([" + ", ".join(f"'{x}'" for x in v) + "] AS VARCHAR[])"
        return f"CAST(NULL AS {_TYPES[k]})" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if _TYPES[k] == "double" else str(v)

    return " UNION ALL ".join("SELECT " + ", ".join(f"{lit(k, v)} AS {k}" for k, v in p.items()) for p in PROFILES)
