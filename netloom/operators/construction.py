"""A weighted network from raw links: cleaned, translated, scored in four ways, fused; and the groups that hold in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import text
from netloom.functions.text import guarded
from netloom.operators import clean, fusion, graph, idmap, similarity
from netloom.operators.order import numbered
from netloom.storage import Store


@dataclass(frozen=True)
class Sources:
    """What a network is built from.

    ``links`` has protein1, protein2, combined_score, the channels and row_id; ``mapping`` uniprot, db, db_id and line_no;
    ``expression`` gene, v and row_id; ``terms`` protein and term, by accession; ``compartments`` protein_id and term.
    """

    links: DataFrame
    mapping: DataFrame
    expression: DataFrame
    terms: DataFrame
    compartments: DataFrame


def _named_links(links: DataFrame, prefix: str, min_score: int, min_channel: int) -> DataFrame:
    """Distinct (protein1, protein2) of the supported links without their prefix, the smaller first: each link once."""
    bare = [text.without(F.col(c), prefix) for c in ("protein1", "protein2")]
    kept = clean.supported_links(links, min_score, min_channel).select(bare[0].alias("a"), bare[1].alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return clean.pair_set(kept, "a", "b").select(F.col("a").alias("protein1"), F.col("b").alias("protein2"))


def _lookup(mapping: DataFrame, prefix: str) -> DataFrame:
    return idmap.lookup(mapping, "STRING", text.without(F.col("db_id"), prefix))


def mapped_links(links: DataFrame, mapping: DataFrame, prefix: str = "4932.", min_score: int = 700, min_channel: int = 90) -> DataFrame:
    """Distinct (u, v) of accessions, u <= v, from the supported links.

    A link given in both directions counts once before it is translated. Ends without an accession drop their link, the
    first line of an identifier counts, and links whose ends come to the same accessions are one edge. An identifier
    with two accessions is no second edge; two identifiers of one accession make a loop.
    """
    return graph.simple(idmap.map_edges(_named_links(links, prefix, min_score, min_channel), _lookup(mapping, prefix)))


def numbered_links(links: DataFrame, mapping: DataFrame, store: Store, prefix: str = "4932.", min_score: int = 700, min_channel: int = 90) -> tuple[DataFrame, DataFrame]:
    """:func:`mapped_links` by numbers of the accessions, in their order, and (protein, id) of these; both are written."""
    table = store.put(_lookup(mapping, prefix).where(F.col("to").isNotNull()))
    nodes, n = numbered(table.select(F.col("to").alias("protein")).distinct(), "id", "protein")
    nodes = store.put(nodes.select("protein", F.col("id").cast("int" if n < 1 << 31 else "long").alias("id")))
    ids = table.join(nodes.hint("merge"), F.col("to") == F.col("protein")).select("key", "id")
    edges = _named_links(links, prefix, min_score, min_channel)
    for end, name in (("protein1", "u"), ("protein2", "v")):
        edges = edges.join(ids.select(F.col("key").alias(end), F.col("id").alias(name)).hint("merge"), end).drop(end)
    return store.put(graph.simple(edges, "u", "v")), nodes


def expression_profiles(expression: DataFrame, mapping: DataFrame, species: str) -> DataFrame:
    """(protein, v): each accession's profile; of several genes of one accession the first by row_id counts."""
    known = idmap.expression_lookup(expression, "gene", mapping, species, "protein").where(F.col("protein").isNotNull())
    return clean.first_row(known.select("protein", "v", "row_id"), "protein", "row_id").select("protein", "v")


def compartment_terms(compartments: DataFrame, mapping: DataFrame, species: str) -> DataFrame:
    """(protein, term) of the compartments whose protein has an accession."""
    known = idmap.map_compartments(compartments, mapping, species).where("Mapping_Status = 'Success'")
    return known.select(F.col("Mapped_UniProtKB_ID").alias("protein"), "term")


#: Nodes that a task holds with their terms, places and profiles.
NODES = 300_000
#: The scores of an edge: functional, place, expression, neighbours.
SCORES = ("FS", "SL", "CO", "HCN")


def scored_edges(edges: DataFrame, nodes: DataFrame, sources: Sources, species: str = "yeast") -> DataFrame:
    """(protein1, protein2 and SCORES) of distinct edges (u, v) of numbered ``nodes`` (protein, id); a score may be null.

    What the scores need of a node, its terms, places and profile, is one row. An edge takes that of its first end along
    to the second, the edges of a node together and to few parts, so that it is compressed to little more than one of
    them; there the nodes are the built side of the join, so that no edge is sorted with what it takes along.
    """
    places = similarity.term_sets(compartment_terms(sources.compartments, sources.mapping, species), "places")
    profiles = similarity.profiles_ready(expression_profiles(sources.expression, sources.mapping, species))
    own = nodes.join(similarity.term_sets(sources.terms, "terms").hint("merge"), "protein", "left").join(places.hint("merge"), "protein", "left")
    own = own.join(profiles.select("protein", F.struct("w", "mean", "norm").alias("profile")).hint("merge"), "protein", "left")
    own = own.select("id", F.struct("protein", "terms", "places", "profile").alias("of"))
    found = similarity.hcn(edges).select(F.col("protein1").alias("u"), F.col("protein2").alias("v"), F.col("HCN_score").alias("HCN"))
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // NODES))
    found = found.join(own.select(F.col("id").alias("u"), F.col("of").alias("u_")).hint("merge"), "u").drop("u")
    last = own.select(F.col("id").alias("v"), F.col("of").alias("v_")).repartition(parts, "v").hint("shuffle_hash")
    found = found.repartition(parts, "v").join(last, "v").drop("v")
    n1, n2 = F.size("u_.terms"), F.size("v_.terms")
    m1, m2 = F.size("u_.places"), F.size("v_.places")
    terms, places = (F.size(F.array_intersect(f"u_.{c}", f"v_.{c}")).cast("long") for c in ("terms", "places"))
    fs = F.when(terms > 0, guarded(terms.cast("double"), F.sqrt((n1.cast("long") * n2).cast("double"))))
    sl = F.when(places > 0, guarded((places * places).cast("double"), (m1.cast("long") * m2).cast("double")))
    return found.select(F.col("u_.protein").alias("protein1"), F.col("v_.protein").alias("protein2"), fs.alias("FS"), sl.alias("SL"), similarity.ready_correlation("u_.profile", "v_.profile").alias("CO"), "HCN")


def scored_network(sources: Sources, species: str = "yeast", prefix: str = "4932.", min_score: int = 700, min_channel: int = 90) -> DataFrame:
    """:func:`scored_edges` of the translated edges, which are written once to the shared folder by numbers."""
    store = Store(sources.links.sparkSession)
    edges, nodes = numbered_links(sources.links, sources.mapping, store, prefix, min_score, min_channel)
    return scored_edges(edges, nodes, sources, species)


def fused_network(scored: DataFrame, fused: str = "intersection") -> DataFrame:
    """(protein1, protein2, mean_weight) of scored edges that have all four scores, or with ``fused="union"`` any of them."""
    if fused not in ("intersection", "union"):
        raise ValueError("fused is intersection or union")
    fuse = fusion.mean_of_all if fused == "intersection" else fusion.mean_of_any
    return scored.select("protein1", "protein2", fuse([F.col(k) for k in SCORES]).alias("mean_weight")).where(F.col("mean_weight").isNotNull())


def build_network(sources: Sources, species: str = "yeast", prefix: str = "4932.", min_score: int = 700, min_channel: int = 90, fused: str = "intersection") -> DataFrame:
    """(protein1, protein2, mean_weight) of the edges that all four scores know, or with ``fused="union"`` any of them.

    Tables without rows give no edges: with ``intersection`` one empty source is enough, as no edge then has all four scores.
    """
    if fused not in ("intersection", "union"):
        raise ValueError("fused is intersection or union")
    return fused_network(scored_network(sources, species, prefix, min_score, min_channel), fused)


def network_summaries(networks: dict[str, DataFrame]) -> DataFrame:
    """(network, proteins, interactions, mean_weight, density) of each network, those without edges left out."""
    out = None
    for name, network in networks.items():
        row = graph.network_stats(network, "mean_weight").where("interactions > 0").select(F.lit(name).alias("network"), "*")
        out = row if out is None else out.union(row)
    return out


def groups_of_network(members: DataFrame, network: DataFrame, min_size: int = 3) -> DataFrame:
    """(complex_id, size, status) of groups (complex_id, protein) over a built network, by the first rule that fails."""
    return graph.filter_groups(members, graph.symmetric(network, "protein1", "protein2"), min_size)
