"""Column expressions: texts, scores, vectors, conflict tests.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Salience defaults, score weights, router words, domains, themes.
DEFAULT_DECAY, MICROS_PER_DAY = 0.01, 86400e6
SCORE_SIMILARITY, SCORE_SALIENCE, SCORE_EDGE = 0.6, 0.3, 0.1
ENTITY_THEMES = {"person": "acteurs", "org": "organisations", "place": "lieux_et_territoires", "concept": "concepts_et_notions",
                 "product": "produits_et_technologies", "date": "temporalite", "other": "divers"}
#: Path keyword -> domain, first hit wins.
DOMAIN_KEYWORDS = [
    ("AGRICULTURE", "agronomie"), ("AGROFORESTERIE", "agronomie"), ("FORESTERIE", "agronomie"), ("ECOSYSTEME", "agronomie"), ("BIOLOGIE", "agronomie"), ("BOTANIQUE", "agronomie"),
    ("BIODIVERSITE", "agronomie"), ("ECOLOGIE", "ecologie"), ("THE", "the"), ("CAMELLIA", "the"), ("GEOGRAPHIE_SANTE", "geographie_sante"), ("GEOSANTE", "geographie_sante"),
    ("GEOSOCIALE", "geographie_sante"), ("SIG", "geomatique"), ("CARTOGRAPHIE", "geomatique"), ("TELEDETECTION", "geomatique"), ("HYDROLOGIE", "geomatique"),
    ("GEOGRAPHIE", "geographie"), ("ANTHROPOLOGIE", "anthropologie"), ("ETHNOLOGIE", "anthropologie"), ("ECONOMIE", "economie"), ("SOCIOLOGIE", "sociologie"), ("HISTOIRE", "histoire"),
    ("PHILOSOPHIE", "philosophie"), ("POLITIQUE", "politique"), ("RELIGION", "religions"), ("IOT_IA_AGRONOMIQUE", "iot_agronomique")]


def sanitize_text(text: Column) -> Column:
    """Drop NULs, join words broken by a hyphen and a line end, collapse blanks and blank lines, strip."""
    out = F.regexp_replace(text, "\\x00", "")
    out = F.regexp_replace(out, r"(?U)(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), (F.length(text) / 4).cast("int")).cast("long")


def subtheme(predicate: Column) -> Column:
    name = F.substring(F.translate(F.lower(predicate), " -", "__"), 1, 40)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("relation")).otherwise(name)


def theme_of(entity_type: Column) -> Column:
    pairs = [F.lit(x) for kv in ENTITY_THEMES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(entity_type)), F.lit("divers"))


def domain_of(path: Column, keywords: list[tuple[str, str]] = DOMAIN_KEYWORDS, default: str = "bibliotheque") -> Column:
    """The domain of the first keyword that the upper-cased path holds."""
    out = F.lit(default)
    for word, domain in reversed(keywords):
        out = F.when(F.contains(F.upper(path), F.lit(word)), F.lit(domain)).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a null or zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clamp01(x: Column) -> Column:
    """``x`` brought into 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MICROS_PER_DAY)


def salience_now(base: Column, decay: Column, since: Column, as_of: Column) -> Column:
    """Salience decayed exponentially by days since the reference time."""
    age = days_between(as_of, F.coalesce(since, as_of))
    return clamp01(F.coalesce(base.cast("double"), F.lit(1.0)) * F.exp(-F.coalesce(decay.cast("double"), F.lit(DEFAULT_DECAY)) * age))


def candidate_score(similarity: Column, salience: Column, edge: Column | float = 1.0) -> Column:
    edge = edge if isinstance(edge, Column) else F.lit(float(edge))
    return clamp01(SCORE_SIMILARITY * similarity + SCORE_SALIENCE * salience + SCORE_EDGE * edge)


#: Negation words, and those taken off before the comparison: only ones that stand before a phrase, with the blank after them.
NEGATIONS = r"(?U)\bnot\b|\bno\b|\bne\b|\bn['`]a\b|\baucun"
STRIPPED = r"(?U)\b(not|no|n['`]a)\s+"


def has_negation(text: Column) -> Column:
    return F.lower(text).rlike(NEGATIONS)


def contradicts(a: Column, b: Column) -> Column:
    """Exactly one side is negated, and without its negation one side contains the other."""
    def one(neg: Column, plain: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.lower(neg), STRIPPED, ""))
        other = F.trim(F.lower(plain))
        return ((bare != "") & F.contains(other, bare)) | F.contains(bare, other)

    na, nb = has_negation(a), has_negation(b)
    return F.when(na & ~nb, one(a, b)).when(nb & ~na, one(b, a)).otherwise(F.lit(False))


def evidence(p1: Column, p2: Column) -> tuple[Column, Column]:
    """(which provenance is stronger: first, second or tie; confidence)."""
    a, b = F.length(F.coalesce(p1, F.lit(""))), F.length(F.coalesce(p2, F.lit("")))
    winner = F.when(a == b, "tie").when(a > b, "first").otherwise("second")
    share = F.least(F.lit(0.95), 0.5 + 0.45 * F.try_divide(F.greatest(a, b).cast("double"), (a + b).cast("double")))
    return winner, F.when(a == b, F.lit(0.5)).otherwise(share)


#: The words that raise each signal, the least score of each level, theme words by priority.
ROUTER_WORDS = {"Cs": ("preuve", "citation", "source", "audit"), "Rk": ("sécurité", "secret", "risque", "compliance"),
                "Ex": ("scientifique", "postgis", "pgvector", "architecture"), "Op": ("migration", "ingestion", "production")}
LEVELS = [(11, "critique"), (9, "renforce"), (7, "standard")]
ROUTE_THEMES = [("spatial", ("postgis", "spatial", "geo", "geospatial")), ("agentic_memory", ("hindsight", "memory", "mémoire", "agentique")),
                ("documentary_rag", ("rag", "document", "citation", "evidence", "preuve")), ("postgres_vector", ("postgres", "pgvector", "vector"))]


def router_score(query: Column, evidence_level: str = "standard") -> tuple[Column, Column]:
    """(score, level): every signal counts 1, or 2 where it fires; words count as substrings."""
    low = F.lower(query)
    score = F.when(F.length(query) > 180, 2).otherwise(1) + F.lit(2 if evidence_level in ("renforce", "critique") else 1)
    for words in ROUTER_WORDS.values():
        score = score + F.when(low.rlike("|".join(words)), 2).otherwise(1)
    level = F.lit("leger")
    for least, name in reversed(LEVELS):
        level = F.when((score >= least) | F.lit(evidence_level == name and name != "standard"), name).otherwise(level)
    return score, level


def query_tokens(query: Column) -> Column:
    """Lower-case tokens without the punctuation at their ends."""
    words = F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]]+|[.,;:!?()\[\]]+$", ""))


def route_theme(query: Column) -> Column:
    """The first theme, by priority, one of whose words is a token of the query."""
    tokens = query_tokens(query)
    out = F.lit("general")
    for theme, words in reversed(ROUTE_THEMES):
        out = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(theme)).otherwise(out)
    return out


def route_query(query: Column, root: str = "memory") -> Column:
    """array<struct<level,label,score>>: domain, theme, subtheme, entity (if there is a token), fact, passage."""
    tokens = query_tokens(query)
    step = lambda level, label, score: F.struct(F.lit(level).alias("level"), label.alias("label"), F.lit(score).alias("score"))
    some = F.size(tokens) > 0
    subtheme_ = F.when(some, F.array_join(F.slice(tokens, 1, 4), "_")).otherwise("unspecified")
    head = F.array(step("domain", F.lit(root), 1.0), step("theme", route_theme(query), 0.9), step("subtheme", subtheme_, 0.6))
    entity = F.when(some, F.array(step("entity", F.try_element_at(tokens, F.lit(1)), 0.4))).otherwise(F.array().cast("array<struct<level:string,label:string,score:double>>"))
    return F.concat(head, entity, F.array(step("fact", F.lit("candidate_facts"), 0.3), step("passage", F.lit("candidate_passages"), 0.2)))


def missing_parts(**sizes: Column) -> Column:
    """Names ``missing_<part>`` of the answer parts whose size is 0."""
    return F.array_compact(F.array(*(F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(f"missing_{k}")) for k, n in sizes.items())))


def mask_secret(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).when(F.length(value) <= 8, F.lit("***")).otherwise(F.concat(F.substring(value, 1, 4), F.lit("..."), F.substring(value, -4, 4)))


def redact(text: Column) -> Column:
    """Fixed patterns of keys, then key=value pairs, whose value goes."""
    out = text
    for pattern in (r"nvapi-[A-Za-z0-9_\-]+", r"sk-[A-Za-z0-9_\-]+"):  # sk- covers sk-proj-
        out = F.regexp_replace(out, pattern, "***")
    return F.regexp_replace(out, r"(?i)(api[_-]?key|token|secret|password|pass)=([^&\s]+)", "$1=***")


def mask_mapping(mapping: Column, secret: str = r"(?i)key|token|secret|password|pass") -> Column:
    """A map whose values under secret-looking names are masked."""
    return F.transform_values(mapping, lambda k, v: F.when(k.rlike(secret), mask_secret(v)).otherwise(v))


def vector_text(vector: Column) -> Column:
    """``[0.1,0.2]``, the text form of a vector."""
    return F.to_json(vector)


def parse_vector(text: Column) -> Column:
    """The vector of a text ``[0.1, 0.2]``; null where it is none."""
    return F.from_json(F.trim(text), "array<float>")


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name: the first 128 bits of SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
