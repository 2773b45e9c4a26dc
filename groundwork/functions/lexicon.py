"""Word lists, phrases, weights and label pairs that results depend on. All are defaults of parameters."""

from __future__ import annotations

# Subject keywords, by group, in their given order.
KEYWORDS = (
    "co2", "carbon dioxide", "methane", "ch4", "nitrous oxide", "n2o", "ozone", "o3", "greenhouse gas", "ghg", "carbon", "cfc", "hfc", "aerosol", "sulfur dioxide", "so2", "water vapor",
    "global warming", "climate change", "temperature rise", "warming", "sea level rise", "ocean acidification", "ice melt", "glacier", "ice sheet", "permafrost", "extreme weather", "heat wave", "drought", "flood", "storm", "hurricane", "cyclone", "precipitation", "rainfall",
    "fossil fuel", "coal", "oil", "petroleum", "natural gas", "gasoline", "diesel", "combustion", "burning", "deforestation", "agriculture", "livestock", "cattle", "rice", "transportation", "vehicle", "car", "truck", "aviation", "shipping", "industry", "cement", "steel", "power plant", "electricity", "emission",
    "greenhouse effect", "carbon cycle", "albedo", "feedback", "radiative forcing", "absorption", "photosynthesis", "respiration", "evaporation", "condensation",
    "biodiversity", "ecosystem", "habitat", "species", "extinction", "coral reef", "forest", "wetland", "food security", "water stress", "migration", "health",
    "temperature", "degree", "celsius", "fahrenheit", "ppm", "parts per million", "concentration", "gigaton", "metric ton", "emissions rate", "anomaly",
    "paris agreement", "ipcc", "mitigation", "adaptation", "renewable energy", "solar", "wind", "carbon tax", "emissions trading", "net zero", "carbon neutral", "sustainability",
    "pre-industrial", "baseline", "trend", "projection", "scenario", "rcp", "ssp", "century", "decade", "annual",
)

# Phrases that speak for a paragraph.
CAUSAL = ("causes", "cause", "caused by", "leads to", "lead to", "results in", "result in", "produces", "produce", "generates", "generate", "contributes to", "contribute to", "drives", "drive", "triggers", "trigger", "induces", "induce", "due to", "because of", "resulting from", "attributed to", "stems from", "arises from", "brings about", "gives rise to")
IMPACT = ("impacts", "impact", "affects", "affect", "influences", "influence", "changes", "change", "alters", "alter", "modifies", "modify", "disrupts", "disrupt", "damages", "damage", "threatens", "threaten")
FACTUAL = ("studies show", "research shows", "evidence indicates", "data reveal", "observations confirm", "research demonstrates", "findings show", "likely", "very likely", "extremely likely", "virtually certain", "high confidence", "medium confidence")

# Phrases that speak against a paragraph.
META = ("this chapter", "this section", "this report", "this paper", "this study", "this document", "this article", "as follows", "is organized", "is structured", "consists of", "divided into", "see section", "see chapter", "described in", "discussed in", "presented in", "shown in", "section 1", "section 2", "section 3", "chapter 1", "chapter 2", "chapter 3")
ACKNOWLEDGMENT = ("we thank", "thank", "grateful", "acknowledge", "acknowledgment", "acknowledgement", "appreciation", "funding", "grant", "support", "funded by", "supported by", "financial support")
METHODOLOGY = ("methodology", "methods section", "statistical analysis", "regression analysis", "data collection", "sample size", "sampling method", "survey", "questionnaire", "interview", "participants", "protocol", "procedure")
AFFILIATION = ("department of", "university", "institute", "email", "@", "corresponding author", "author contribution", "orcid")
FIGURE_TABLE = ("see figure", "see table", "shown in figure", "shown in table", "as shown in fig", "table 1", "table 2", "figure 1", "figure 2", "fig.", "tab.")

# Patterns of quantities (case-insensitive).
QUANTITIES = (r"\d+\.?\d*\s*%", r"\d+\.?\d*\s*°[CF]", r"\d+\.?\d*\s*ppm", r"\d+\.?\d*\s*gigatons?", r"\d+\.?\d*\s*Gt", r"\d+\.?\d*\s*metric tons?", r"\d+\.?\d*\s*cm", r"\d+\.?\d*\s*meters?")

# Points of the paragraph score, with the names that they have there.
BASE_POINTS = 50
POINTS = {
    "climate_keyword_density_high": 30, "climate_keyword_density_medium": 20, "climate_keyword_density_low": 10, "causal_language": 15, "quantitative_data": 15, "impact_language": 10, "factual_tone": 10, "proper_length": 5,
    "meta_organizational": -20, "heavy_citations": -30, "acknowledgment": -25, "methodology_heavy": -20, "author_affiliation": -20, "figure_table_only": -15, "wrong_length": -10,
}

# What marks a table of contents or a list, and references to boxes, figures and tables.
LIST_INDICATORS = ("list of boxes", "list of figures", "list of tables", "table of contents", "contents")
TOC_PATTERNS = (r"\.{3,}", r"Box\s+\d+\.\d+:", r"Figure\s+\d+\.\d+:", r"Table\s+\d+\.\d+:", r"Chapter\s+\d+\.{3,}", r"Section\s+\d+\.{3,}")
PAGE_REFERENCE = r"\.{3,}\s*\d+\s*$"
CAPTIONS = (r"Box\s+\d+\.\d+", r"Figure\s+\d+\.\d+", r"Table\s+\d+\.\d+", r"Fig\.\s+\d+\.\d+")

# Words that are no keywords of a question.
STOP = ("what", "why", "how", "who", "does", "the", "this", "that", "with", "from", "into", "about", "when", "are", "and", "for", "would", "could", "should", "which", "their", "there", "have", "been", "toward", "influence", "explain", "describe", "tell", "important", "mean", "definition")

# Labels whose pairs have no relation, and pairs whose relation is given.
SKIP_LABELS = ("quantity", "date", "publication", "reference", "academic_reference", "citation")
RELATIONS = (
    ("emission_source", "greenhouse_gas", "EMITS"),
    ("greenhouse_gas", "climate_process", "CAUSES"),
    ("greenhouse_gas", "climate_impact", "CAUSES"),
    ("greenhouse_gas", "climate_effect", "CAUSES"),
    ("emission_source", "climate_process", "CONTRIBUTES_TO"),
    ("emission_source", "climate_impact", "CONTRIBUTES_TO"),
    ("emission_source", "climate_effect", "CONTRIBUTES_TO"),
    ("greenhouse_gas", "emission_source", "EMITTED_BY"),
    ("climate_process", "emission_source", "CAUSED_BY"),
    ("climate_impact", "greenhouse_gas", "CAUSED_BY"),
    ("climate_impact", "emission_source", "CAUSED_BY"),
    ("climate_policy", "emission_source", "REGULATES"),
    ("climate_policy", "greenhouse_gas", "REDUCES"),
    ("climate_policy", "climate_impact", "MITIGATES"),
    ("climate_policy", "climate_effect", "MITIGATES"),
    ("organization", "climate_policy", "IMPLEMENTS"),
    ("organization", "emission_source", "MONITORS"),
    ("organization", "greenhouse_gas", "MONITORS"),
    ("technology", "emission_source", "REPLACES"),
    ("technology", "greenhouse_gas", "REDUCES"),
    ("technology", "climate_policy", "ENABLES"),
    ("technology", "climate_impact", "MITIGATES"),
    ("ecosystem", "greenhouse_gas", "ABSORBS"),
    ("ecosystem", "climate_impact", "AFFECTED_BY"),
    ("ecosystem", "climate_effect", "AFFECTED_BY"),
    ("greenhouse_gas", "emission_metric", "MEASURED_BY"),
    ("emission_source", "emission_metric", "MEASURED_BY"),
    ("climate_effect", "emission_metric", "MEASURED_BY"),
)

# Entity kinds that a recogniser's hints are kept for.
HINT_LABELS = ("ORG", "GPE", "LOC", "LAW", "DATE")

# Lines of a log and ways to say that nothing was found.
LOG_PHRASES = ("Valid Cypher generated on attempt", "Cypher validation failed on attempt", "All retries failed", "Using fallback query", "Fallback query generated:", "Loading schema", "Schema loaded")
NO_INFO_PHRASES = ("no information found", "not available in the knowledge graph", "no relevant information", "this information is not available")
NO_INFO = "No information found in the knowledge graph."
PREFIXES = ("based on the information provided,", "based on the provided facts,", "based on the knowledge graph,", "according to the facts,", "in the knowledge graph,", "based on the information,")

# Words that a fallback lookup passes over.
FALLBACK_STOP = ("what", "is", "are", "how", "why", "does", "do", "the", "a", "an", "in", "for", "to", "of", "and", "or", "with", "about", "can", "will", "was", "were", "related", "here", "heres", "improved", "rewritten", "question")

# The message of a run's error, and the phrase by which answers without information are counted.
ERROR_MARK = "Error:"
NO_INFO_MARK = "No information found"

# Answers where evidence is weak or missing, and instructions for fine-tuning.
WEAK_EVIDENCE = "Uncertainty: Retrieved evidence does not strongly match this question. Sources: TEXT:0, KG:0"
NO_EVIDENCE = "Uncertainty: There is insufficient retrieved evidence to answer this question confidently. Sources: TEXT:0, KG:0"
EMPTY_QUESTION = "Error: Empty or invalid question provided."
FACTUAL_INSTRUCTION = "Provide a precise factual answer. Do not guess. If unsure, say you don't know."
OTHER_INSTRUCTION = "Provide a clear and accurate explanation. Avoid speculation."

# Instruction texts that leak into answers, as patterns (case-insensitive).
LEAKS_AT_START = (
    r"^you are an expert climate science assistant\.?\s*",
    r"^be precise, cite sources, and express uncertainty if evidence is insufficient\.?\s*",
    r"^use proper grammar and punctuation\.?\s*",
    r"^use proper grammar and spelling\.?\s*",
    r"^\s*answer\s*[:\-]\s*",
    r"^\s*rewritten\s+answer\s*[:\-]\s*",
)
LEAKS_INLINE = (
    r"\buse proper grammar and punctuation\.?\s*",
    r"\buse proper grammar and spelling\.?\s*",
    r"\b(?:answer|rewritten\s+answer)\s*[:\-]\s*",
)
HEADINGS = (
    r"^#+\s*",
    r"^step\s*\d+\s*:\s*",
    r"\bstep\s*\d+\s*:\s*[^.?!]*[.?!]?\s*",
    r"^let(?:'|’)s\s+think\s+step\s+by\s+step\.?\s*",
)
LEAKED_WRITE = r"(Sources:\s*TEXT:\d+,\s*KG:[^\s.,;:]+)\s*Write\s+"
LEAKED_BULLETS = (
    r"^-\s*Do not use phrases like[^.]*\.\s*",
    r"^-\s*Do not include inline citation tags[^.]*\.\s*",
    r"^-\s*Keep the answer to\s*3-4\s*sentences\.?\s*",
    r"^-\s*Add one final line as:[^.]*\.\s*",
    r"^-\s*If evidence is weak[^.]*\.\s*",
)
LEAK_SENTENCES = (
    r"^do not make up information\.?$",
    r"^do not make unsupported claims\.?$",
    r"^you are an expert climate science assistant\b.*$",
    r"^be precise, cite sources\b.*$",
    r"^use proper grammar and punctuation\.?$",
    r"^use proper grammar and spelling\.?$",
    r"^step\s*\d+\s*:.*$",
    r"^let(?:'|’)s\s+think\s+step\s+by\s+step\.?$",
    r"^answer requirements:?$",
    r"^answer:?$",
    r"^write a response\b.*$",
    r"^write a short summary\b.*$",
    r"^question:?\b.*$",
)
SANITIZE_AT_START = (
    r"^\s*Answer\s*[:\-]\s*",
    r"^\s*Rewritten\s+answer\s*[:\-]\s*",
    r"^Do not make up information\.?\s*",
    r"^Do not make unsupported claims\.?\s*",
    r"^Use proper grammar and spelling\.?\s*",
    r"^Use proper grammar and punctuation\.?\s*",
    r"^You are an expert climate science assistant\.?\s*",
    r"^Be precise, cite sources, and express uncertainty if evidence is insufficient\.?\s*",
)
SANITIZE_INLINE = (
    r"\bUse proper grammar and spelling\.?\s*",
    r"\bUse proper grammar and punctuation\.?\s*",
    r"\bAnswer\s*[:\-]\s*",
    r"\bWrite a response\b.*$",
    r"\bAnswer requirements:?\b.*$",
)

# Where an unfinished answer may end (marks, words from a place on, words of a clause, words at most), what gives
# an answer up, under which keys models put lists, and the parts of an answer that is put together from evidence.
CLAUSE_MARKS = (",", ";", ":")
CLAUSE_WORDS = (" because ", " which ", " that ", " and ")
CLAUSE_FROM, CLAUSE_LEAST, SENTENCE_MOST = 20, 6, 28
GIVES_UP = ("i do not know", "i don't know")
LIST_KEYS = ("entities", "classified_entities", "results")
EVIDENCE_FIRST = ("For '", "', retrieved evidence indicates: ", ".")
EVIDENCE_SECOND = ("Additional supporting evidence: ", ".")
EVIDENCE_THIRD = ("Further context: ", ".")
SOURCES, SOURCE_TEXT, SOURCE_GRAPH = "\nSources: ", "TEXT:1", "KG:entity_name"
