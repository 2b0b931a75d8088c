"""Who answers for whom: links from agencies to their town halls, and what is inherited along links of any depth.

Ancestors are found by pointer doubling: each round every entity looks where its pointer's pointer points, so a chain of a
thousand links takes ten joins. Rounds are written down, so that each starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acquimetra.sources.tables import checkpointed

# The legal nature of a town hall, and of those that answer to one with their relationship.
TOWN = "Município"
RELATIONSHIPS = {
    "Órgão Público do Poder Executivo Municipal": "prefeitura",
    "Administração Municipal": "prefeitura",
    "Órgão Público do Poder Legislativo Municipal": "camara",
    "Fundação Pública de Direito Público Municipal": "fundacao",
    "Autarquia Municipal": "autarquia",
    "Serviço Autônomo Municipal": "autarquia",
    "Fundo Público da Administração Direta Municipal": "fundo",
    "Fundo Municipal": "fundo",
    "Conselho Municipal": "conselho",
}


def build(entities: DataFrame, covered: DataFrame, notices: DataFrame) -> DataFrame:
    """(id, parent, relationship, outcome) of every entity whose nature makes it answer to a town hall.

    entities: (id, nature, code, root, active); covered: (id) with coverage of their own; notices: (root) of agencies with notices of their own. The town hall
    is the active one of the same code, that with the greatest id if there are several. outcome says why there is no parent; null codes find none.
    """
    relation = F.create_map(*[F.lit(x) for kv in RELATIONSHIPS.items() for x in kv])
    halls = entities.where((F.col("nature") == TOWN) & F.col("active") & F.col("code").isNotNull()).groupBy("code").agg(F.max("id").alias("_hall"))
    own = covered.select(F.col("id").alias("_own")).distinct()
    busy = notices.select(F.col("root").alias("_busy")).distinct()
    x = entities.withColumn("relationship", F.try_element_at(relation, F.col("nature"))).where("relationship is not null")
    x = x.join(halls, "code", "left").join(own, F.col("id") == F.col("_own"), "left").join(busy, F.col("root") == F.col("_busy"), "left")
    outcome = (
        F.when(~F.coalesce("active", F.lit(False)), "inactive").when(F.coalesce(F.trim(F.col("code").cast("string")), F.lit("")) == "", "no_code").when(F.col("_own").isNotNull(), "already_covered")
        .when((F.col("relationship") == "camara") & F.col("_busy").isNotNull(), "camara_with_notices").when(F.col("_hall").isNull(), "no_town_hall").otherwise("linked")
    )
    return x.withColumn("outcome", outcome).select("id", F.when(F.col("outcome") == "linked", F.col("_hall")).alias("parent"), "relationship", "outcome")


def ancestors(links: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, root, depth, nearest, steps, cyclic) of every id in ``links`` (id, parent) or as a parent in it.

    root is the last ancestor, depth the number of links to it; nearest is the first of the id itself and its ancestors that is in ``marked`` (id), steps
    the number of links to that. An id whose ancestors run in a circle is cyclic and has no root or depth. Null parents and equal
    rows are ignored; of several parents the least counts.
    """
    up = links.where("id is not null and parent is not null").groupBy("id").agg(F.min("parent").alias("jump"))
    ids = up.select("id").union(up.select("jump")).distinct()
    own = marked.select(F.col("id").alias("_m")).distinct()
    x = ids.join(up, "id", "left").join(own, F.col("id") == F.col("_m"), "left")
    x = x.select("id", "jump", F.coalesce("jump", "id").alias("root"), F.when(F.col("jump").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("_m").alias("nearest"), F.when(F.col("_m").isNotNull(), 0).cast("long").alias("steps"))
    x = checkpointed(x)
    most, span, open_ = x.count(), 1, True
    while open_ and span <= most:
        other = x.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("nearest").alias("_nearest"), F.col("steps").alias("_steps"))
        met = x.join(other, F.col("jump") == F.col("_id"), "left")
        on = F.col("jump").isNotNull()
        x = checkpointed(
            met.select(
                "id", F.col("_jump").alias("jump"), F.when(on, F.col("_root")).otherwise(F.col("root")).alias("root"), (F.col("depth") + F.coalesce(F.when(on, F.col("_depth")), F.lit(0))).alias("depth"),
                F.coalesce("nearest", "_nearest").alias("nearest"), F.coalesce("steps", F.col("_steps") + F.lit(span)).alias("steps"),
            )
        )
        span *= 2
        open_ = x.where("jump is not null").limit(1).count() > 0
    cyclic = F.col("jump").isNotNull()
    return x.select("id", F.when(~cyclic, F.col("root")).alias("root"), F.when(~cyclic, F.col("depth")).alias("depth"), "nearest", "steps", cyclic.alias("cyclic"))


def cascade(entities: DataFrame, links: DataFrame, coverage: DataFrame) -> DataFrame:
    """(id, covered, method, by): coverage of one's own first, else by the nearest covered ancestor.

    entities: (id); coverage: (id, covered, method); of several rows of an id one that covers counts, then the least method.
    """
    own = coverage.where("covered").groupBy("id").agg(F.min(F.coalesce("method", F.lit("direct"))).alias("_method"))
    found = ancestors(links, own).select(F.col("id").alias("_id"), "nearest")
    x = entities.select("id").join(own, "id", "left").join(found, F.col("id") == F.col("_id"), "left")
    by = F.when(F.col("_method").isNotNull(), F.col("id")).otherwise(F.col("nearest"))
    return x.select("id", by.isNotNull().alias("covered"), F.coalesce("_method", F.when(by.isNotNull(), "hierarchical")).alias("method"), by.alias("by"))
