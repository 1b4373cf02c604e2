"""Thresholds and fixed values of the trend computations."""

from __future__ import annotations

from dataclasses import dataclass

# Words that no phrase may hold.
STOP_WORDS = tuple(
    """
    a an and are as at be by for from has have in into is it its of on or the their this that
    to with without will was were how what when where who why about after before over under
    versus vs amid new latest first more using use can may could should beyond through
    de la le les des du au aux en un une est sont et pour dans avec sur par pas
    que qui ce cette ces plus moins comme entre dont il elle ils elles mais alors
    """.split()
)

# Themes in the order in which their patterns are tried.
THEME_PATTERNS = (
    ("geek", r"gaming|gamer|gamers|video games?|jeux? vid[eé]o|pokemon|pokémon|nintendo|playstation|xbox|steam deck|cosplay|anime|manga|comic books?|comics|marvel|dc comics|star wars|star trek|esports?|e-sports?|minecraft|roblox|dungeons dragons"),
    ("energy", r"lithium|uranium|copper|cuivre|batter(?:y|ies)|batterie|electric grid|energy storage|solar power|nuclear power|renewable energy|oil prices?|rare earths"),
    ("health", r"cancer|oncology|vaccine|vaccin|clinical trial|clinical trials|drug discovery|biotech|alzheimer|diabetes|genomics|gene therapy"),
    ("technology", r"artificial intelligence|machine learning|large language models?|llm agents?|gpu clusters?|semiconductors?|robotics?|quantum computing|ai agents?|coding agents?"),
    ("economics", r"interest rates?|inflation|unemployment|central bank|bond yields?|economic growth|recession"),
    ("geopolitics", r"election|élection|sanctions?|tariffs?|trade war|geopolitic|political crisis"),
    ("climate", r"global warming|climate change|climate crisis|wildfires?|drought|flooding|biodiversity"),
    ("society", r"birth rate|population growth|migration|demographic|aging population|student debt"),
    ("industry", r"supply chain|manufacturing capacity|factory automation|industrial robots?|shipping costs?|semiconductor packaging"),
)

# The theme of a source's domain where no pattern holds.
DOMAIN_THEMES = {
    "geek": "geek", "culture": "pop_culture", "social": "technology", "news": "pop_culture", "technology": "technology",
    "science": "science", "patents": "science", "macroeconomics": "economics", "markets": "economics",
    "geopolitics": "geopolitics", "geography": "climate", "demography": "society", "commodities": "energy",
    "supply_chain": "industry", "health": "health",
}
OTHER_THEME = "pop_culture"
OTHER_DOMAIN = "news"

# Phrases of templated titles.
NOISE_PHRASES = (
    "notice inventory", "inventory completion", "notice inventory completion", "commission implementing",
    "commission implementing regulation", "european parliament", "states senate", "united states senate", "language models",
    "large language", "error correction", "quantum error", "notice intended", "study finds", "bbc news", "cbs news",
    "abc news", "new york times", "implementing regulation", "implementing regulation november", "regulation november",
    "announces approval", "announces approval two", "applications mutual", "notice intended repatriation",
)
NOISE_PATTERN = "notice|implementing|repatriation|regulation november"


@dataclass(frozen=True)
class Acceleration:
    """Gates of the source charts."""

    days: int = 21
    observed: int = 21
    documents: int = 35
    mentions: int = 4
    active_days: int = 2
    top: int = 5


@dataclass(frozen=True)
class Growth:
    """Gates and frames of the domain charts."""

    history: int = 28
    snapshots: int = 90
    measurable: int = 14
    count: int = 2
    top: int = 20


@dataclass(frozen=True)
class Themes:
    """Gates and smoothing of the theme charts."""

    documents: int = 10
    count: int = 2
    smoothing: int = 80
    top: int = 20

#: Every theme there is, whether it has phrases or not.
THEME_IDS = sorted({*(name for name, _ in THEME_PATTERNS), *DOMAIN_THEMES.values(), OTHER_THEME})
