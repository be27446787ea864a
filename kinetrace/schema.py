"""Declarations: which vector slices, horizons and representations a robot uses."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum


class Representation(Enum):
    ABSOLUTE = "absolute"
    RELATIVE = "relative"
    DELTA = "delta"
    REL_XYZ_ROT6D = "rel_xyz_rot6d"


class Kind(Enum):
    EEF = "eef"
    NON_EEF = "non_eef"


class Layout(Enum):
    """How a pose's values lie in a row; of joints only the default."""

    DEFAULT = "default"
    XYZ = "xyz"
    ROT6D = "rot6d"
    XYZ_ROT6D = "xyz+rot6d"
    XYZ_ROTVEC = "xyz+rotvec"


#: Engagement keys of clutched robots, and where raw states hold engagement and links.
ENGAGED = {"left": "hapticengaged_left", "right": "hapticengaged_right"}
LINKED = {"left": "armlinkedtohaptic_left", "right": "armlinkedtohaptic_right"}
RAW_ENGAGED, RAW_LINKED = {"left": 16, "right": 17}, {"left": 20, "right": 21}


def parse_enum(kind: type[Enum], value):
    """By name or value, whatever the case; members pass through."""
    if isinstance(value, kind):
        return value
    for member in kind:
        if str(value).lower() in (member.name.lower(), member.value.lower()):
            return member
    raise ValueError(f"{value!r} is no {kind.__name__}")


@dataclass(frozen=True)
class ActionSpec:
    """How an action key is re-expressed and normalised.

    ``rotation`` and ``reference`` name the forms of rotations in actions and in the reference state: quat, quat_wxyz,
    rot6d or euler.  ``normalization`` is temporal_meanstd, meanstd, minmax or skip.
    """

    representation: Representation = Representation.ABSOLUTE
    kind: Kind = Kind.NON_EEF
    layout: Layout = Layout.DEFAULT
    state_key: str | None = None
    normalization: str = "temporal_meanstd"
    rotation: str = "quat"
    reference: str = "rot6d"
    translation_scale_key: str | None = None
    rotation_scale_key: str | None = None
    hold: bool = False

    @classmethod
    def parse(cls, spec: Mapping) -> ActionSpec:
        own = dict(spec)
        for name, kind in (("representation", Representation), ("kind", Kind), ("layout", Layout)):
            if name in own:
                own[name] = parse_enum(kind, own[name])
        return cls(**own)


@dataclass(frozen=True)
class ModalitySpec:
    """Keys of a modality and the offsets at which they are sampled."""

    keys: tuple[str, ...]
    offsets: tuple[int, ...] = (0,)
    actions: tuple[ActionSpec, ...] = ()
    pass_through: frozenset[str] = frozenset()
    mean_std_keys: frozenset[str] = frozenset()
    sin_cos_keys: frozenset[str] = frozenset()

    def __post_init__(self):
        if self.actions and len(self.actions) != len(self.keys):
            raise ValueError(f"{len(self.actions)} action specs for {len(self.keys)} keys")
        if list(self.offsets) != sorted(set(self.offsets)):
            raise ValueError("offsets must ascend")

    @classmethod
    def parse(cls, spec: Mapping) -> ModalitySpec:
        """From a mapping as JSON holds it: lists for tuples and sets, mappings for action specs."""
        own = dict(spec)
        for name, kind in (("keys", tuple), ("offsets", tuple), ("pass_through", frozenset), ("mean_std_keys", frozenset), ("sin_cos_keys", frozenset)):
            if name in own:
                own[name] = kind(own[name] or ())
        if own.get("actions"):
            own["actions"] = tuple(a if isinstance(a, ActionSpec) else ActionSpec.parse(a) for a in own["actions"])
        return cls(**own)

    @property
    def model_keys(self) -> tuple[str, ...]:
        """Keys that a model sees: those that serve computations alone are left out."""
        return tuple(k for k in self.keys if k not in self.pass_through)

    def action_of(self, key: str) -> ActionSpec | None:
        return dict(zip(self.keys, self.actions, strict=True)).get(key) if self.actions else None

    @property
    def horizon(self) -> int:
        """Replay horizon: from the first to the last offset, both included."""
        return self.offsets[-1] - self.offsets[0] + 1


@dataclass(frozen=True)
class Slice:
    """Where a key's values lie: [start, end) of a vector column, or of several columns put together."""

    start: int
    end: int
    original_key: str | None = None
    original_keys: tuple[str, ...] = ()
    is_text: bool = False

    @property
    def dim(self) -> int:
        return self.end - self.start


@dataclass(frozen=True)
class Embodiment:
    tag: str
    horizon: int
    start: int = 0
    stride: int = 1
    rotation: str = "none"
    language: str = "task"
    traits: frozenset[str] = frozenset()

    @property
    def offsets(self) -> tuple[int, ...]:
        return tuple(self.start + i * self.stride for i in range(self.horizon))


# Name, tag, horizon, first offset, stride, rotation, language key, traits.
CATALOGUE = (
    ("OXE_DROID_RELATIVE_EEF_RELATIVE_JOINT", "oxe_droid_relative_eef_relative_joint", 40, 0, 1, "rot6d", "annotation.language.language_instruction", ("video_history",)),
    ("XDOF", "xdof_relative_eef_relative_joint", 40, 0, 1, "rot6d", "annotation.language.language_instruction", ()),
    ("XDOF_SUBTASK", "xdof_relative_eef_relative_joint_subtask", 40, 0, 1, "rot6d", "annotation.language.language_instruction", ()),
    ("REAL_G1", "real_g1_relative_eef_relative_joints", 50, 0, 1, "rot6d", "annotation.human.task_description", ()),
    ("REAL_R1_PRO_SHARPA", "real_r1_pro_sharpa_relative_eef", 50, 0, 1, "rot6d", "annotation.human.task_description", ()),
    ("REAL_R1_PRO_SHARPA_HUMAN", "real_r1_pro_sharpa_relative_eef_human", 50, 0, 1, "rot6d", "annotation.human.task_description", ()),
    ("REAL_R1_PRO_SHARPA_MAXINSIGHTS", "real_r1_pro_sharpa_relative_eef_maxinsights", 50, 0, 1, "rot6d", "annotation.human.task_description", ()),
    ("REAL_R1_PRO_SHARPA_MECKA", "real_r1_pro_sharpa_relative_eef_mecka", 50, 0, 1, "rot6d", "annotation.human.task_description", ()),
    ("UNITREE_G1", "unitree_g1_full_body_with_waist_height_nav_cmd", 50, 0, 1, "none", "annotation.human.task_description", ()),
    ("SIMPLER_ENV_GOOGLE", "simpler_env_google", 8, 0, 1, "euler", "annotation.human.action.task_description", ()),
    ("SIMPLER_ENV_WIDOWX", "simpler_env_widowx", 8, 0, 1, "euler", "annotation.human.action.task_description", ()),
    ("LIBERO_PANDA", "libero_sim", 16, 0, 1, "euler", "annotation.human.action.task_description", ()),
    ("JHU_IMERSE_DVRK", "jhu_imerse_dvrk", 50, 0, 1, "quat", "annotation.human.task_description", ()),
    ("JHU_IMERSE_DVRK_MONO", "jhu_imerse_dvrk_mono", 50, 0, 1, "quat", "annotation.human.task_description", ()),
    ("JHU_LSCR_DVRK_MIRACLE", "jhu_lscr_dvrk_miracle", 25, 1, 1, "quat", "annotation.task", ()),
    ("JHU_LSCR_DVRK_SMARTS", "jhu_lscr_dvrk_smarts", 16, 1, 1, "quat", "annotation.task", ()),
    ("JHU_IMERSE_DVRK_STAR_IL", "jhu_imerse_star_il", 50, 1, 1, "quat", "annotation.human.task_description", ("text", "pass_through")),
    ("CMR_VERSIUS", "cmr_versius", 50, 2, 2, "quat", "annotation.human.task_description", ("scaling", "hold", "engagement")),
    ("UCB_DVRK", "ucb_dvrk", 50, 0, 1, "quat", "task", ()),
    ("OBUDA_DVRK", "obuda_dvrk", 50, 0, 1, "quat", "task", ()),
    ("MOON_MAESTRO", "moon_maestro", 50, 0, 1, "none", "annotation.task", ("delta",)),
    ("UCSD_DVRK", "ucsd_dvrk", 50, 1, 1, "quat_wxyz", "task", ("terminal",)),
    ("STANFORD_DVRK_REAL", "stanford_dvrk_real", 50, 0, 1, "euler", "task", ()),
    ("SANOSCIENCE_SIM", "sanoscience_sim", 36, 1, 1, "quat", "task", ()),
    ("TUM_SONATA_FRANKA", "tum_sonata_franka", 50, 1, 1, "euler", "task", ()),
    ("USTC_TORIN_TUODAO", "ustc_torin_tuodao", 50, 0, 1, "quat", "annotation.instruction", ("text", "pass_through")),
    ("TUD_TUNDRA_UR5E", "tud_tundra_ur5e", 50, 1, 1, "quat", "task", ("copy_eef",)),
    ("TURIN_MITIC_EX_VIVO", "turin_mitic_ex_vivo", 50, 1, 1, "quat", "annotation.instruction", ("text", "pass_through")),
    ("ROB_SURGICAL_BITRACK", "rob_surgical_bitrack", 50, 0, 1, "euler", "annotation.instruction", ("tool_text",)),
    ("HAMLYN_DVRK_15HZ", "hamlyn_dvrk_15hz", 25, 0, 1, "quat_wxyz", "task", ()),
    ("HAMLYN_DVRK_30HZ", "hamlyn_dvrk_30hz", 50, 0, 1, "quat_wxyz", "task", ()),
    ("POLYU_SIM", "polyu_sim", 50, 1, 1, "quat", "task", ("copy_eef",)),
    ("NEW_EMBODIMENT", "new_embodiment", 16, 0, 1, "none", "annotation.human.task_description", ("relative_joints",)),
)

#: Names of tags that the base model knows, that need a finetuned one, and that serve finetuning alone.
PRETRAINED = frozenset({"OXE_DROID_RELATIVE_EEF_RELATIVE_JOINT", "XDOF", "XDOF_SUBTASK", "REAL_G1", "REAL_R1_PRO_SHARPA", "REAL_R1_PRO_SHARPA_HUMAN", "REAL_R1_PRO_SHARPA_MAXINSIGHTS", "REAL_R1_PRO_SHARPA_MECKA"})
POSTTRAINED = frozenset({"UNITREE_G1", "SIMPLER_ENV_GOOGLE", "SIMPLER_ENV_WIDOWX", "LIBERO_PANDA"})
FINETUNED = frozenset({"NEW_EMBODIMENT"})


class Registry:
    """Embodiments and their modality specs by tag."""

    def __init__(self):
        self.embodiments = {tag: Embodiment(tag, horizon, start, stride, rotation, language, frozenset(traits)) for _, tag, horizon, start, stride, rotation, language, traits in CATALOGUE}
        self.names = {name: tag for name, tag, *_ in CATALOGUE}
        self.specs: dict[str, dict[str, ModalitySpec]] = {}

    def register(self, tag: str, spec: dict[str, ModalitySpec], embodiment: Embodiment | None = None) -> None:
        if tag in self.specs:
            raise ValueError(f"{tag} is registered already")
        self.specs[tag] = spec
        if embodiment is not None:
            self.embodiments[tag] = embodiment

    def resolve(self, tag: str) -> Embodiment:
        """By name first, then by tag, whatever the case."""
        wanted = tag.strip().lower()
        for known in (self.names, {t: t for t in self.embodiments}):
            for name, found in known.items():
                if name.lower() == wanted:
                    return self.embodiments[found]
        raise KeyError(f"unknown embodiment {tag}; known: {', '.join(sorted(self.embodiments))}")

    def name_of(self, tag: str) -> str:
        """The name of a tag, or the tag itself if it has none."""
        return next((name for name, t in self.names.items() if t == tag), tag)

    def stage_of(self, tag: str) -> str:
        """pretrained, posttrained or finetuned; other tags are finetuned too."""
        name = self.name_of(self.resolve(tag).tag)
        return "pretrained" if name in PRETRAINED else "posttrained" if name in POSTTRAINED else "finetuned"


registry = Registry()


def check_language(spec: ModalitySpec) -> str:
    """The one language key that is used: the first; only offset 0 makes sense."""
    if not spec.keys:
        raise ValueError("language needs a key")
    if spec.offsets != (0,):
        raise ValueError("language is sampled at offset 0 only")
    key = spec.keys[0]
    if key not in ("task", "sub_task") and not key.startswith("annotation."):
        raise ValueError(f"language key {key} is neither task, sub_task nor annotation.*")
    return key


@dataclass
class MixtureConfig:
    """Datasets of a run with their tags and mix ratios."""

    datasets: list[tuple[str, str, float]] = field(default_factory=list)

    def validate(self, known: Registry = registry) -> None:
        if not self.datasets or sum(ratio for _, _, ratio in self.datasets) <= 0:
            raise ValueError("mix ratios must add up to more than 0")
        for _, tag, ratio in self.datasets:
            known.resolve(tag)
            if ratio < 0:
                raise ValueError("mix ratios can't be negative")
