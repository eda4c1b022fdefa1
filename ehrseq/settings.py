"""Options of the jobs."""

from dataclasses import dataclass, field

from ehrseq.schema import PIPELINE_MISSING_VISIT_CONCEPT


@dataclass
class MappingSettings:
    """What turns CDM tables into sequences; kept beside the output for later runs."""

    map_drugs_to_ingredients: bool = True
    concepts_to_remove: list[int] = field(default_factory=lambda: [0])
    has_labels: bool = False
    missing_visit_concept_id: int = PIPELINE_MISSING_VISIT_CONCEPT


@dataclass
class ExampleSettings:
    """What a training example holds."""

    max_length: int = 512
    truncate: str = "random"
    seed: int = 0
    token_ids: bool = True
    visit_token_ids: bool = True
    segments: bool = True
    visit_orders: bool = True
    ages: bool = True
    dates: bool = True
    mask_concepts: bool = False
    one_mask_per_visit: bool = False
    mask_visits: bool = False
    label: bool = False
    next_token: bool = False
    next_visit: bool = False
    dense_next_visit: bool = False

    def __post_init__(self):
        if self.truncate not in ("random", "tail"):
            raise ValueError(f"truncate must be 'random' or 'tail', not {self.truncate!r}")
        if self.next_token and (self.next_visit or self.label or self.mask_concepts or self.mask_visits):
            raise ValueError("a next-token target cannot be combined with any other target")
        if (self.mask_concepts or self.next_token) and not self.token_ids:
            raise ValueError("masked concepts and next-token targets need token_ids")
        if self.mask_visits and not self.visit_token_ids:
            raise ValueError("masked visit concepts need visit_token_ids")

    def for_evaluation(self):
        """The same inputs without masking."""
        options = {**self.__dict__, "mask_concepts": False, "one_mask_per_visit": False, "mask_visits": False}
        return ExampleSettings(**options)
