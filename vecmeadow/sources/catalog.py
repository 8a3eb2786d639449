"""The label dimension: default species, taxon synonyms and keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, common name, taxon, vocal band in Hz (low, high), wanted
# recordings. The scientific name is the id with a space and a capital.
SPECIES = [
    ("corvus_splendens", "House Crow", "aves", 800, 3500, 40),
    ("corvus_culminatus", "Indian Jungle Crow", "aves", 600, 2500, 30),
    ("eudynamys_scolopaceus", "Asian Koel", "aves", 1000, 2800, 30),
    ("acridotheres_tristis", "Common Myna", "aves", 1200, 5000, 30),
    ("copsychus_fulicatus", "Indian Robin", "aves", 2000, 6000, 25),
    ("pycnonotus_cafer", "Red-vented Bulbul", "aves", 1500, 4500, 30),
    ("centropus_sinensis", "Greater Coucal", "aves", 200, 600, 25),
    ("psilopogon_haemacephalus", "Coppersmith Barbet", "aves", 1000, 1800, 30),
    ("psittacula_krameri", "Rose-ringed Parakeet", "aves", 2000, 6500, 30),
    ("pavo_cristatus", "Indian Peafowl", "aves", 500, 3000, 30),
    ("halcyon_smyrnensis", "White-throated Kingfisher", "aves", 2000, 5500, 25),
    ("milvus_migrans", "Black Kite", "aves", 1500, 4000, 25),
    ("athene_brama", "Spotted Owlet", "aves", 1000, 3500, 25),
    ("copsychus_saularis", "Oriental Magpie-Robin", "aves", 2000, 6500, 25),
    ("cinnyris_asiaticus", "Purple Sunbird", "aves", 3500, 8000, 25),
    ("gryllus_bimaculatus", "Two-spotted Cricket", "insecta", 4500, 6000, 20),
    ("teleogryllus_occipitalis", "Asian Field Cricket", "insecta", 4000, 7000, 20),
    ("oecanthus_indicus", "Tree Cricket", "insecta", 2000, 3500, 20),
    ("mecopoda_elongata", "Short-winged Katydid", "insecta", 2000, 20000, 20),
    ("cryptotympana_aguila", "Clear-winged Cicada", "insecta", 5000, 14000, 20),
    ("purana_tigrina", "Large Brown Cicada", "insecta", 4000, 12000, 20),
    ("euconocephalus_varius", "Conehead Katydid", "insecta", 8000, 18000, 20),
    ("gryllotalpa_orientalis", "Mole Cricket", "insecta", 1500, 2500, 20),
    ("hoplobatrachus_tigerinus", "Indian Bullfrog", "amphibia", 300, 1800, 25),
    ("duttaphrynus_melanostictus", "Common Indian Toad", "amphibia", 800, 2200, 25),
    ("polypedates_maculatus", "Indian Tree Frog", "amphibia", 600, 2500, 20),
    ("euphlyctis_cyanophlyctis", "Skittering Frog", "amphibia", 1000, 3200, 20),
    ("hydrophylax_bahuvistara", "Fungoid Frog", "amphibia", 400, 1600, 20),
    ("funambulus_palmarum", "Indian Palm Squirrel", "mammalia", 2500, 8000, 25),
    ("macaca_mulatta", "Rhesus Macaque", "mammalia", 300, 3500, 25),
    ("semnopithecus_entellus", "Hanuman Langur", "mammalia", 200, 2000, 25),
    ("canis_aureus", "Golden Jackal", "mammalia", 400, 2800, 20),
    ("muntiacus_muntjak", "Barking Deer", "mammalia", 250, 1500, 20),
]

# Accepted spellings of the four taxa.
TAXON_SYNONYMS = {
    "bird": "aves",
    "aves": "aves",
    "insect": "insecta",
    "insecta": "insecta",
    "amphibian": "amphibia",
    "amphibia": "amphibia",
    "frog": "amphibia",
    "mammal": "mammalia",
    "mammalia": "mammalia",
}

# Name fragments that imply a taxon, tried in this order.
AMPHIBIA_WORDS = (
    "hoplobatrachus",
    "duttaphrynus",
    "polypedates",
    "euphlyctis",
    "hydrophylax",
    "microhyla",
    "kaloula",
    "sphaerotheca",
    "fejervarya",
    "nyctibatrachus",
    "uperodon",
    "minervarya",
    "raorchestes",
    "indirana",
    "nasikabatrachus",
    "xanthophryne",
)
INSECTA_WORDS = (
    "gryllus",
    "teleogryllus",
    "oecanthus",
    "mecopoda",
    "cryptotympana",
    "purana",
    "euconocephalus",
    "gryllotalpa",
    "cicada",
    "cricket",
    "katydid",
    "locust",
    "acrid",
    "hierodula",
    "conocephalus",
    "homorocoryphus",
    "gampsocleis",
    "valanga",
    "hieroglyphus",
    "acheta",
    "schistocerca",
)
MAMMALIA_WORDS = (
    "funambulus",
    "macaca",
    "semnopithecus",
    "canis",
    "muntiacus",
    "elephas",
    "panthera",
    "axis",
    "vulpes",
    "sus",
    "boselaphus",
    "cervus",
    "rusa",
    "antilope",
    "bos",
    "bubalus",
    "herpestes",
    "viverra",
    "felis",
    "prionailurus",
    "melursus",
    "hystrix",
)
TAXON_WORDS = {"amphibia": AMPHIBIA_WORDS, "insecta": INSECTA_WORDS, "mammalia": MAMMALIA_WORDS}


def default_species() -> list[tuple]:
    rows = []
    for position, (name, common, taxon, low, high, wanted) in enumerate(SPECIES):
        scientific = name.replace("_", " ").capitalize()
        rows.append((position, name, scientific, common, taxon, low, high, wanted))
    return rows


def species(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The dimension table: a user's own JSON lines file, or the default rows."""
    schema = (
        "position int, species_id string, scientific_name string, common_name string, taxon string, "
        "band_low int, band_high int, target int"
    )
    if path:
        return spark.read.schema(schema).json(path)
    return spark.createDataFrame(default_species(), schema)


def label_map(df: DataFrame, text: str) -> DataFrame:
    """``key, value`` rows of a JSON object column."""
    return df.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


def canonical_taxon(c: Column) -> Column:
    """Trimmed lower-case taxon with synonyms resolved; other text passes through."""
    clean = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for pair in TAXON_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, clean), clean)


def in_taxon(df: DataFrame, column: str, taxon: str) -> DataFrame:
    return df.filter(canonical_taxon(F.col(column)) == canonical_taxon(F.lit(taxon)))


def taxon_by_keyword(label: Column) -> Column:
    """First keyword group that occurs in the label; anything else is ``aves``."""
    rule = None
    for taxon, words in TAXON_WORDS.items():
        hit = F.lower(label).rlike("|".join(words))
        rule = F.when(hit, taxon) if rule is None else rule.when(hit, taxon)
    return rule.otherwise("aves")


def taxon_of(labels: DataFrame, catalog: DataFrame, extra: DataFrame, label: str = "label") -> DataFrame:
    """Taxon per label: the extra map wins over the catalog, keywords fill the rest.

    ``catalog`` and ``extra`` hold ``label, taxon`` with one row per label.
    """
    rows = labels.join(catalog.select(F.col("label").alias(label), F.col("taxon").alias("__c")), label, "left")
    rows = rows.join(extra.select(F.col("label").alias(label), F.col("taxon").alias("__x")), label, "left")
    taxon = F.coalesce("__x", "__c", taxon_by_keyword(F.col(label)))
    return rows.withColumn("taxon", taxon).drop("__x", "__c")


def resolve_names(requests: DataFrame, dimension: DataFrame, name: str = "name") -> DataFrame:
    """Find each requested name by id (exact, then ignoring case), scientific or common name.

    Adds ``species_id``, null where nothing fits. The lookup runs on the distinct
    names, and in each step the smallest matching id is used.
    """
    wanted = requests.select(F.trim(name).alias("__name")).distinct()
    low = F.lower("__name")

    def by(key: Column, out: str) -> DataFrame:
        return dimension.groupBy(key.alias("__key")).agg(F.min("species_id").alias(out))

    found = wanted
    steps = [
        ("__exact", F.col("species_id"), F.col("__name")),
        ("__id", F.lower("species_id"), low),
        ("__sci", F.lower("scientific_name"), low),
        ("__com", F.lower("common_name"), low),
    ]
    for out, key, probe in steps:
        found = found.join(by(key, out).withColumnRenamed("__key", f"{out}_key"), probe == F.col(f"{out}_key"), "left")
    found = found.select("__name", F.coalesce("__exact", "__id", "__sci", "__com").alias("species_id"))
    return requests.withColumn("__name", F.trim(name)).join(found, "__name", "left").drop("__name")


def taxon_summary(dimension: DataFrame, taxon: str = "taxon") -> DataFrame:
    """Rows per taxon, repeated under each of its names (also capitalised); taxa without rows count 0."""
    spark = dimension.sparkSession
    names = {(a, t) for a, t in TAXON_SYNONYMS.items() if a != "frog"}
    names |= {(t.capitalize(), t) for t in set(TAXON_SYNONYMS.values())}
    aliases = spark.createDataFrame(sorted(names), "name string, taxon string")
    counts = dimension.groupBy(canonical_taxon(F.col(taxon)).alias("taxon")).agg(F.count(F.lit(1)).alias("n"))
    return aliases.join(counts, "taxon", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
