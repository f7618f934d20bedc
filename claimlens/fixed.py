"""Labels, weights, patterns and formats that results depend on."""

# Verdict labels in their order: score, description, badge colour, post mark.
LABELS = [
    ("True", 10.0, "Accurate and supported by primary sources. The claim is factually correct.", "✅"),
    ("Mostly True", 7.5, "Accurate but missing nuance or important context that changes the picture.", "🟢"),
    ("Misleading", 4.0, "Technically accurate framing that implies something false or creates a false impression.", "⚠️"),
    ("Exaggerated", 5.0, "Directionally correct but substantially overstated. The underlying fact exists but the degree or scope is inflated.", "📊"),
    ("False", 0.0, "Contradicted by credible evidence. The claim is factually incorrect.", "❌"),
    ("Unverifiable", 5.0, "Insufficient evidence exists to confirm or deny this claim with confidence.", "❓"),
]
CONFIDENCES = ["High", "Medium", "Low"]
# Source tiers, most trusted first, with their weights.
TIERS = [("Government", "1.00"), ("Wire", "0.85"), ("Established", "0.70"), ("Academic", "0.80"), ("FactCheck", "0.75"), ("Other", "0.40")]
# Evaluation: gold labels to positions in the order true, mostly true, exaggerated, misleading, unverifiable, false.
GOLD_POSITION = {"TRUE": 0, "PARTLY TRUE": 1, "EXAGGERATED": 2, "MISLEADING": 3, "FALSE / MISLEADING": 3, "UNSUPPORTED": 4, "UNVERIFIABLE": 4, "FALSE": 5}
LABEL_POSITION = {"True": 0, "Mostly True": 1, "Exaggerated": 2, "Misleading": 3, "Unverifiable": 4, "False": 5}
UNKNOWN_POSITION = 4
# Domains of each tier, matched anywhere in the lower-cased address, in order.
TIER_DOMAINS = [
    ("Government", [".gov", ".mil", "bls.gov", "census.gov", "cbo.gov", "federalreserve.gov"]),
    ("Wire", ["apnews.com", "reuters.com"]),
    ("Established", ["nytimes.com", "washingtonpost.com", "bbc.com", "bbc.co.uk", "nbcnews.com", "cbsnews.com", "abcnews.go.com", "npr.org"]),
    ("FactCheck", ["politifact.com", "factcheck.org", "snopes.com", "fullfact.org"]),
]
FACT_CHECK_DOMAINS = ["politifact.com", "factcheck.org", "snopes.com", "fullfact.org", "apnews.com/hub/ap-fact-check"]
FACT_CHECK_NAMES = [("politifact.com", "PolitiFact"), ("factcheck.org", "FactCheck.org"), ("snopes.com", "Snopes"), ("fullfact.org", "Full Fact"), ("apnews.com", "AP Fact Check")]
ECONOMIC_WORDS = ["unemployment", "jobs", "employed", "inflation", "cpi", "gdp", "deficit", "debt", "wages", "salary", "income", "poverty", "population", "census"]
SERIES = [("unemployment", "UNRATE"), ("inflation", "CPIAUCSL"), ("gdp", "GDP"), ("deficit", "FYFSD"), ("jobs", "PAYEMS")]
DATE_FORMATS = [
    (r"\b(\w+ \d{1,2},\s*\d{4})\b", "MMMM d, yyyy", "%B %d, %Y"),
    (r"\b(\d{4}-\d{2}-\d{2})\b", "yyyy-MM-dd", "%Y-%m-%d"),
    (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", "M/d/yyyy", "%m/%d/%Y"),
    (r"\b(\d{1,2} \w+ \d{4})\b", "d MMMM yyyy", "%d %B %Y"),
    (r"\b(\d{1,2} \w+ \d{4})\b", "d MMM yyyy", "%d %b %Y"),
]
VENUE_PHRASE = r"(?i)(?:delivered at|speaking at|address(?:ed)? (?:to|at)|remarks? (?:at|before|to))\s+(.+?)(?:\.|,|$)"
VENUE_NAME = r"(?i)(?:State of the Union|Oval Office|Rose Garden|United Nations|Congress)"
DATA_SIGNALS = [r"\b\d+(\.\d+)?%", r"\$\d+", r"\b\d{4}\b", r"\bBLS\b", r"\bBEA\b", r"\bEIA\b", r"\bCBP\b", r"\bFBI\b", r"\bFactCheck\b", r"\bPolitiFact\b", r"\bAP\b", r"\bReuters\b", r"\bFreddie Mac\b", r"\bAAA\b", r"\bGasBuddy\b", r"\bcredible\b", r"\bprimary\b", r"\bofficial\b", r"\bdata\b", r"\bpercent\b", r"\bmillion\b", r"\bbillion\b", r"\btrillion\b"]
SOURCE_SIGNALS = [r"\bBLS\b", r"\bBEA\b", r"\bEIA\b", r"\bCBP\b", r"\bFBI\b", r"\bCBO\b", r"\bCensus\b", r"\bFederal Reserve\b", r"\bFred\b", r"\bFreddie Mac\b", r"\bAP\b", r"\bReuters\b", r"\bNYT\b", r"\bWashington Post\b", r"\bNew York Times\b", r"\bCBS\b", r"\bBBC\b", r"\bPolitiFact\b", r"\bFactCheck\.org\b", r"\bSnopes\b", r"\bNY Fed\b", r"\bFederal Reserve\b", r"\bgov\b", r"\bgovernment\b"]
# Subtitles: a cue's timing, what shows that there are any, the lines that number cues, the file's header.
SUBTITLE_TIMING = r"\d{2}:\d{2}:\d{2}[,\.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,\.]\d{3}"
SUBTITLE_MARK = r"\d{2}:\d{2}:\d{2}[,\.]\d{3}\s*-->"
SUBTITLE_NUMBER, SUBTITLE_HEADER = r"(?md)^\d+\s*$", r"(?md)^WEBVTT.*$"
# What goes from HTML before its tags do, and its tags.
HTML_HIDDEN = [r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"]
HTML_TAG = r"<[^>]+>"
# Badge colours by label, and of any other.
COLOURS = [("True", "#2e7d32"), ("Mostly True", "#558b2f"), ("Misleading", "#f57c00"), ("Exaggerated", "#ef6c00"), ("False", "#c62828"), ("Unverifiable", "#546e7a")]
OTHER_COLOUR = "#999"
# Names of the gold set's sources.
SOURCE_NAMES = [("R1", "American Presidency Project (Government archive)"), ("R4", "PolitiFact (FactCheck organization)"), ("R5", "FactCheck.org (FactCheck organization)"), ("R6", "CBS News (Established outlet)"), ("R7", "Freddie Mac PMMS (Government/financial data)"), ("R8", "Associated Press (Wire service)")]
# Categories whose claims are searched for as figures.
FIGURE_CATEGORIES = ["economy", "jobs", "unemployment"]
# Choices of each gene, extraction first.
EXTRACTION_GENES = {"persona": 5, "methodology": 4, "taxonomy": 4, "format": 4, "filtering": 3, "examples": 3, "tone": 4}
SYNTHESIS_GENES = {"persona": 4, "verdict_taxonomy": 4, "evidence_weighting": 3, "confidence": 3, "reasoning": 3, "nuance": 3, "format": 3}
# What strip() takes off: white space of any kind.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Genomes that a population starts with after the baseline: choices in the order of the genes above, extraction first.
SEED_GENOMES = [
    [1, 1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 1, 1],
    [4, 3, 3, 0, 2, 2, 3, 2, 3, 2, 2, 2, 2, 2],
    [3, 2, 2, 3, 1, 0, 1, 3, 2, 1, 1, 1, 1, 0],
]
# How logs name genes, and what they say of those that are carried on.
GENE_NAMES = {"e": "extraction.{}_idx", "s": "synthesis.{}_idx"}
CARRIED = "[elite carry-forward]"
