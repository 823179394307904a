"""Vocabulary shared by all operators: kinds, levels, codes and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# They are part of the data format and must keep this spelling.
KINDS = ("Department", "Program")
LEVELS = ("department", "college", "institution")
UNIT_TYPES = ("Department", "Program", "Medical", "Clinical")
KIND_UNIT_TYPES = {
    "Department": ("Department", "Medical", "Clinical"),
    "Program": ("Program", "Medical", "Clinical"),
}
WORK_TYPES = (
    "Article",
    "Conference Proceeding",
    "Book",
    "Book Chapter",
    "Federal Grant",
    "Patent",
    "Clinical Trial",
)
TYPE_COLUMNS = {
    "Article": "n_articles",
    "Conference Proceeding": "n_confproc",
    "Book": "n_books",
    "Book Chapter": "n_chapters",
    "Federal Grant": "n_grants",
    "Patent": "n_patents",
    "Clinical Trial": "n_trials",
}
WITHIN, ACROSS, EXTERNAL = 0, 1, 2
RELATION_NAMES = {WITHIN: "within", ACROSS: "across", EXTERNAL: "inter"}
SCOPES = {
    "within": (WITHIN,),
    "across": (ACROSS,),
    "intra": (WITHIN, ACROSS),
    "inter": (EXTERNAL,),
    "all": (WITHIN, ACROSS, EXTERNAL),
}
RANK_CODES = {1: "Professor", 2: "Associate Professor", 3: "Assistant Professor"}

# The flat fact: focal side, collaborator side, work.
DETAILS_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("InstitutionId", T.StringType()),
            ("InstitutionName", T.StringType()),
            ("College", T.StringType()),
            ("UnitId", T.StringType()),
            ("Department", T.StringType()),
            ("UnitType", T.StringType()),
            ("PersonId", T.StringType()),
            ("PersonName", T.StringType()),
            ("Broad_Field", T.StringType()),
            ("Discipline", T.StringType()),
            ("CollaborationType", T.StringType()),
            ("Collab_InstitutionId", T.StringType()),
            ("Collab_Institution", T.StringType()),
            ("Collab_State", T.StringType()),
            ("Collab_College", T.StringType()),
            ("Collab_UnitId", T.StringType()),
            ("Collab_Department", T.StringType()),
            ("Collab_UnitType", T.StringType()),
            ("Collab_BF", T.StringType()),
            ("Collab_Disc", T.StringType()),
            ("Collab_PersonID", T.StringType()),
            ("Collab_PersonName", T.StringType()),
            ("Year", T.IntegerType()),
            ("Collab_ID", T.StringType()),
            ("Collab_Detail", T.StringType()),
            ("Collab_Title", T.StringType()),
            ("Rank", T.StringType()),
            ("Collab_Dir", T.StringType()),
            ("Relationship", T.StringType()),
        ]
    ]
)


def kinds_of(unit_type: Column) -> Column:
    """Kinds a unit type belongs to; Medical and Clinical belong to both."""
    return (
        F.when(unit_type.isin("Medical", "Clinical"), F.array(*[F.lit(k) for k in KINDS]))
        .when(unit_type.isin(*KINDS), F.array(unit_type))
        .otherwise(F.array().cast("array<string>"))
    )


def in_kind(affil: DataFrame, kind: str | None) -> DataFrame:
    """Affiliation rows of one kind; ``None`` keeps every kind."""
    if kind is None:
        return affil
    return affil.filter(F.col("unit_type").isin(*KIND_UNIT_TYPES[kind]))


def level_key(level: str) -> Column:
    """Grouping key of an affiliation row at a level, as a string."""
    if level == "department":
        return F.col("unit_id").cast("string")
    if level == "college":
        return F.col("college")
    if level == "institution":
        return F.col("inst")
    raise ValueError(f"unknown level {level!r}")


def relation_name(code: Column) -> Column:
    return F.when(code == WITHIN, "within").when(code == ACROSS, "across").otherwise("inter")
