"""Recipes and settings: the declarative side of sampling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .errors import ConfigurationError

SPLITS = ("train", "validation", "test")
STRATEGIES = ("wrong_article", "wrong_publication_date", "question_answer_mismatch")
MAX_TICKETS = 16


@dataclass(frozen=True)
class SplitRatios:
    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1

    def __post_init__(self) -> None:
        if min(self.train, self.validation, self.test) < 0 or abs(self.train + self.validation + self.test - 1) > 1e-6:
            raise ConfigurationError("split ratios must be non-negative and add up to 1")


@dataclass(frozen=True)
class Selector:
    """kind: role, paragraph, temporal_offset or random; value: role name, index or days."""

    kind: str = "random"
    value: str | int | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("role", "paragraph", "temporal_offset", "random"):
            raise ConfigurationError(f"no such selector: {self.kind}")


@dataclass(frozen=True)
class TripletRecipe:
    name: str
    anchor: Selector = Selector()
    positive: Selector = Selector()
    negative: Selector = Selector()
    strategy: str = "wrong_article"
    weight: float = 1.0
    instruction: str | None = None
    allow_same_anchor_positive: bool = False
    #: Anchor and positive are two windows of one long section, whatever their selectors.
    long_section: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ConfigurationError(f"no such strategy: {self.strategy}")


@dataclass(frozen=True)
class TextRecipe:
    name: str
    selector: Selector = Selector()
    weight: float = 1.0
    instruction: str | None = None


@dataclass(frozen=True)
class ChunkingStrategy:
    window: int = 1024
    overlaps: tuple[int, ...] = (64,)
    fallback_weight: float = 0.35
    fallback_tokens: int = 512
    weight_floor: float = 0.1
    preprocessors: tuple = ()
    #: Text column -> array of tokens; white space where none is given.
    tokenizer: Callable | None = None

    def __post_init__(self) -> None:
        if self.window <= 0:
            raise ConfigurationError("a window must hold a token")


@dataclass(frozen=True)
class SamplerConfig:
    seed: int = 42
    batch_size: int = 128
    #: Records that a refresh reads of each source; None reads all.
    max_records: int | None = None
    #: Whether sources with sections longer than the window get a recipe of long sections.
    long_sections: bool = True
    recipes: tuple[TripletRecipe, ...] = ()
    text_recipes: tuple[TextRecipe, ...] = ()
    ratios: SplitRatios = SplitRatios()
    allowed_splits: tuple[str, ...] = ("train",)
    chunking: ChunkingStrategy = field(default_factory=ChunkingStrategy)

    def check_split(self, split: str) -> None:
        if split not in self.allowed_splits:
            raise ConfigurationError(f"split {split} is not allowed")


ANCHOR, CONTEXT = Selector("role", "anchor"), Selector("role", "context")


def title_context_recipes(date_aware: bool = False) -> tuple[TripletRecipe, ...]:
    """Default recipes of title and body; with dates, part of the weight goes to wrong-date negatives."""
    t = lambda name, neg, strategy, w: TripletRecipe(name, ANCHOR, CONTEXT, neg, strategy, w)
    if not date_aware:
        return (t("title_context_wrong_article", CONTEXT, "wrong_article", 0.75), t("title_anchor_wrong_article", ANCHOR, "wrong_article", 0.25))
    return (
        t("title_context_wrong_date", CONTEXT, "wrong_publication_date", 0.30),
        t("title_anchor_wrong_date", ANCHOR, "wrong_publication_date", 0.10),
        t("title_context_wrong_article", CONTEXT, "wrong_article", 0.35),
        t("title_anchor_wrong_article", ANCHOR, "wrong_article", 0.25),
    )


def row_recipes(has_anchor: bool) -> tuple[TripletRecipe, ...]:
    """Default recipes of row sources: role columns, or one text that is its own positive."""
    if not has_anchor:
        return (TripletRecipe("text_simcse", CONTEXT, CONTEXT, CONTEXT, allow_same_anchor_positive=True),)
    return (TripletRecipe("anchor_positive_context", ANCHOR, CONTEXT, CONTEXT, weight=0.75), TripletRecipe("anchor_positive_anchor", ANCHOR, CONTEXT, ANCHOR, weight=0.25))


def long_section_recipe(source: str) -> TripletRecipe:
    """Added for sources with a section longer than the window: two windows of one section."""
    return TripletRecipe(f"{source}_long_sections", CONTEXT, CONTEXT, CONTEXT, long_section=True)


def text_recipes(config: SamplerConfig, defaults: tuple[TripletRecipe, ...] = ()) -> tuple[TextRecipe, ...]:
    """The configured text recipes, else one for each slot of the triplet recipes."""
    if config.text_recipes:
        return config.text_recipes
    recipes = config.recipes or defaults
    return tuple(TextRecipe(f"{r.name}_{slot}", getattr(r, slot), r.weight) for r in recipes for slot in ("anchor", "positive", "negative"))


def tickets(weights: dict[str, float]) -> dict[str, int]:
    """Draws a cycle: round(weight / least weight), from 1 to MAX_TICKETS; weights of 0 or less none."""
    some = {k: w for k, w in weights.items() if w > 0}
    if not some:
        raise ConfigurationError("no recipe has a positive weight")
    least = min(some.values())
    return {k: min(MAX_TICKETS, max(1, int(w / least + 0.5))) for k, w in some.items()}
