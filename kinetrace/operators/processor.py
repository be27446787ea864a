"""Raw states and actions to what a model sees, and back: one plan of Column expressions for each direction.

A frame holds ``state.<key>`` (an array at the anchor) and ``action.<key>`` (an array of rows).  Order on the way in: relative
forms, motion scaling, clutch, normalisation; on the way back: the inverses but for the clutch, which can't be undone.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.functions import normalize as N
from kinetrace.functions import poses as P
from kinetrace.functions.rotations import sin_cos
from kinetrace.schema import ENGAGED, ActionSpec, Kind, Layout, ModalitySpec, Representation

from . import actions as A

POSE = 9


def literal(values) -> Column:
    """A list of numbers, or of lists of them, as a constant array."""
    return F.array(*[literal(v) if isinstance(v, (list, tuple)) else F.lit(float(v)) for v in values])


def _depth(values) -> int:
    return 2 if values and isinstance(values[0], (list, tuple)) else 1


def by_row(chunk: Column, stats: dict, names: tuple[str, ...], f: Callable[..., Column], width: int | None = None) -> Column:
    """f(row, statistics) for each row of a chunk: statistics of shape (horizon, dim) row by row, of shape (dim) for all."""
    own = [stats[n] for n in names]
    cut = lambda v: [x[:width] for x in v] if _depth(v) == 2 else v[:width]
    own = [cut(v) if width else v for v in own]
    if any(_depth(v) == 2 for v in own):
        own = [literal(v if _depth(v) == 2 else [v]) for v in own]
        at = lambda v, t: F.get(v, F.least(t, F.size(v) - 1))
        return F.transform(chunk, lambda row, t: f(row, *[at(v, t) for v in own]))
    own = [literal(v) for v in own]
    return F.transform(chunk, lambda row: f(row, *own))


class Processor:
    """Normalisation and re-expression by embodiment tag.

    ``specs``: tag -> modality (state, action) -> ModalitySpec.  ``statistics``: tag -> modality -> key -> statistic -> values.
    """

    def __init__(self, specs: dict[str, dict[str, ModalitySpec]], statistics: dict | None = None, *, use_percentiles: bool = False, clip_outliers: bool = True, sin_cos_encoding: bool = False, relative: bool = True):
        self.specs, self.statistics = specs, {}
        self.use_percentiles, self.clip_outliers, self.sin_cos_encoding, self.relative = use_percentiles, clip_outliers, sin_cos_encoding, relative
        if statistics:
            self.set_statistics(statistics)

    # -- parameters --------------------------------------------------------------------------------------------------

    def set_statistics(self, statistics: dict, override: bool = False) -> list[str]:
        """Takes statistics of tags that have none yet, or of all if asked; returns the tags that were skipped."""
        skipped = [tag for tag in statistics if tag in self.statistics and not override]
        for tag in statistics:
            if tag not in skipped:
                self.statistics[tag] = deepcopy(statistics[tag])
        return skipped

    def params(self, tag: str, modality: str, key: str) -> dict:
        """A key's statistics with its ``dim``; relative action keys take those of relative actions."""
        known = self.statistics.get(tag, {})
        own = known.get(modality, {}).get(key)
        if own is None:
            raise KeyError(f"no statistics of {modality} {key} for {tag}")
        first = next(own[n] for n in ("q02", "q01", "min", "mean") if n in own)
        dim = len(first[0]) if _depth(first) == 2 else len(first)
        action = self._action(tag, key) if modality == "action" else None
        if action is not None and action.representation is Representation.RELATIVE and self.relative:
            if key not in known.get("relative_action", {}):
                raise ValueError(f"{key} of {tag} needs statistics of relative actions")
            own = known["relative_action"][key]
        if action is not None and _is_pose(action):
            dim = POSE
        out = {**own, "dim": dim}
        if self.use_percentiles and (action is None or action.representation is not Representation.RELATIVE):
            out |= {"min": own["q01"], "max": own["q99"]}
        return out

    def _action(self, tag: str, key: str) -> ActionSpec | None:
        spec = self.specs.get(tag, {}).get("action")
        return spec.action_of(key) if spec is not None else None

    def state_dim(self, tag: str, expanded: bool = False) -> int:
        """Values of all state keys that a model sees; sine and cosine double theirs if ``expanded``."""
        spec = self.specs[tag]["state"]
        twice = lambda k: 2 if expanded and self.sin_cos_encoding and k in spec.sin_cos_keys else 1
        return sum(self.params(tag, "state", k)["dim"] * twice(k) for k in spec.model_keys)

    def action_dim(self, tag: str) -> int:
        return sum(self.params(tag, "action", k)["dim"] for k in self.specs[tag]["action"].model_keys)

    # -- states ------------------------------------------------------------------------------------------------------

    def apply_state(self, df: DataFrame, tag: str) -> DataFrame:
        """state.* normalised; keys that only serve computations stay as they are."""
        return self._states(df, tag, back=False)

    def unapply_state(self, df: DataFrame, tag: str) -> DataFrame:
        return self._states(df, tag, back=True)

    def _states(self, df: DataFrame, tag: str, back: bool) -> DataFrame:
        spec, out = self.specs[tag]["state"], {}
        for key in spec.keys:
            if f"state.{key}" not in df.columns:
                raise KeyError(f"state {key} is missing")
            x = F.col(f"`state.{key}`")
            coded = self.sin_cos_encoding and key in spec.sin_cos_keys
            if coded and back:
                raise ValueError(f"{key} was encoded by sine and cosine, which can't be undone")
            if coded:
                out[f"state.{key}"] = sin_cos(x)
            elif key in spec.mean_std_keys:
                p = self.params(tag, "state", key)
                out[f"state.{key}"] = (N.from_mean_std if back else N.mean_std)(x, literal(p["mean"]), literal(p["std"]))
            elif key not in spec.pass_through:
                p = self.params(tag, "state", key)
                low, high = literal(p["min"]), literal(p["max"])
                out[f"state.{key}"] = N.from_minmax(x, low, high) if back else N.minmax(x, low, high, clip=self.clip_outliers)
        return df.withColumns({name: x for name, x in out.items()}) if out else df

    # -- actions -----------------------------------------------------------------------------------------------------

    def _reference(self, df: DataFrame, tag: str, key: str, action: ActionSpec) -> Column:
        name = f"state.{action.state_key or key}"
        if name not in df.columns:
            raise KeyError(f"{key} of {tag} needs {name} as its reference")
        return F.col(f"`{name}`")

    def scales(self, df: DataFrame, tag: str, action: ActionSpec) -> tuple[Column, Column] | None:
        """A row's translation and rotation scale, 1 where none is declared; None where neither is."""
        if not action.translation_scale_key and not action.rotation_scale_key:
            return None
        out = []
        for key in (action.translation_scale_key, action.rotation_scale_key):
            if key and f"state.{key}" not in df.columns:
                raise KeyError(f"scale {key} of {tag} is missing")
            out.append(F.col(f"`state.{key}`")[0].cast("double") if key else F.lit(1.0))
        return out[0], out[1]

    def _engaged(self, df: DataFrame, key: str) -> str | None:
        side = next((s for s in ENGAGED if s in key), None)
        return ENGAGED[side] if side and f"action.{ENGAGED[side]}" in df.columns else None

    def _relative(self, df: DataFrame, tag: str, key: str, action: ActionSpec) -> Column:
        chunk = F.col(f"`action.{key}`")
        if action.representation is Representation.RELATIVE:
            reference = self._reference(df, tag, key, action)
            return P.relative_rows(chunk, reference, action.layout) if action.kind is Kind.EEF else A.joint_relative(chunk, reference)
        reference, engaged = self._reference(df, tag, key, action), self._engaged(df, key)
        if engaged is not None:
            on = F.transform(F.col(f"`action.{engaged}`"), lambda row: row[0] != 0)
            at_start = F.col(f"`state.{engaged}`")[0] > 0.5 if f"state.{engaged}" in df.columns else F.lit(True)
            out = A.engaged_rel_xyz_rot6d(chunk, on, reference, at_start, action.rotation, action.reference)
        else:
            out = A.rel_xyz_rot6d(chunk, reference, action.rotation, action.reference)
        scales = self.scales(df, tag, action)
        return out if scales is None else A.scaled_chunk(out, *scales)

    def _clutched(self, df: DataFrame, tag: str) -> DataFrame:
        """Rests or holds disengaged rows of both sides; engagement must be an action, row by row."""
        spec, names = self.specs[tag]["action"], list(ENGAGED.values())
        if not all(f"action.{n}" in df.columns for n in names):
            if all(f"state.{n}" in df.columns for n in names):
                raise ValueError(f"{tag} states engagement, which must be among its actions, and passed through, for the clutch")
            return df
        on = {side: F.transform(F.col(f"`action.{n}`"), lambda row: row[0] != 0) for side, n in ENGAGED.items()}
        out = {}
        for key in spec.keys:
            action = spec.action_of(key)
            if key in names or action is None:
                continue
            relative = action.representation in (Representation.RELATIVE, Representation.REL_XYZ_ROT6D)
            rests = action.layout is Layout.XYZ_ROT6D
            state = self._reference(df, tag, key, action) if action.hold and not relative and action.state_key else None
            out[f"action.{key}"] = A.clutch(key, F.col(f"`action.{key}`"), on, relative_rot6d=rests and (relative or not action.hold), hold=action.hold and not relative, state=state)
        return df.withColumns(out).drop(*[f"action.{n}" for n in names])

    def apply_action(self, df: DataFrame, tag: str) -> DataFrame:
        """action.* re-expressed, clutched and normalised; keys that only serve computations go."""
        spec, out = self.specs[tag]["action"], {}
        for key in spec.keys:
            if key not in spec.pass_through and f"action.{key}" not in df.columns:
                raise KeyError(f"action {key} is missing")
            action = spec.action_of(key)
            if self.relative and action is not None and action.representation in (Representation.RELATIVE, Representation.REL_XYZ_ROT6D):
                out[f"action.{key}"] = self._relative(df, tag, key, action)
        df = df.withColumns(out) if out else df
        df = self._clutched(df, tag)
        df = df.drop(*[f"action.{k}" for k in spec.pass_through])
        return df.withColumns({f"action.{k}": self._normalised(tag, k, F.col(f"`action.{k}`"), back=False) for k in spec.model_keys})

    def _normalised(self, tag: str, key: str, chunk: Column, back: bool) -> Column:
        action = self._action(tag, key)
        how = action.normalization if action is not None else "temporal_meanstd"
        if how == "skip":
            return chunk
        p = self.params(tag, "action", key)
        if how == "minmax":
            return by_row(chunk, p, ("min", "max"), N.from_minmax if back else N.minmax)
        scored = N.from_mean_std if back else N.mean_std
        if action is not None and _is_pose(action):
            # Rotations are bounded as they are; only the translation's statistics count, however many were kept.
            return by_row(chunk, p, ("mean", "std"), lambda row, m, s: F.concat(scored(F.slice(row, 1, 3), m, s), F.slice(row, F.lit(4), F.size(row) - 3)), width=3)
        return by_row(chunk, p, ("mean", "std"), scored)

    def unapply_action(self, df: DataFrame, tag: str) -> DataFrame:
        """Denormalises, takes scales out and makes relative forms absolute; state.* must be raw."""
        spec = self.specs[tag]["action"]
        missing = [k for k in spec.model_keys if f"action.{k}" not in df.columns]
        if missing:
            raise KeyError(f"actions {missing} are missing")
        df = df.withColumns({f"action.{k}": self._normalised(tag, k, F.col(f"`action.{k}`"), back=True) for k in spec.model_keys})
        out = {}
        for key in spec.model_keys:
            action, chunk = spec.action_of(key), F.col(f"`action.{key}`")
            if not self.relative or action is None:
                continue
            if action.representation is Representation.RELATIVE:
                reference = self._reference(df, tag, key, action)
                out[f"action.{key}"] = P.absolute_rows(chunk, reference, action.layout) if action.kind is Kind.EEF else A.joint_absolute(chunk, reference)
            elif action.representation is Representation.REL_XYZ_ROT6D:
                scales = self.scales(df, tag, action)
                chunk = chunk if scales is None else A.scaled_chunk(chunk, *scales, undo=True)
                out[f"action.{key}"] = A.abs_from_rel(chunk, self._reference(df, tag, key, action), action.rotation, action.reference)
        return df.withColumns(out) if out else df

    # -- both --------------------------------------------------------------------------------------------------------

    def apply(self, df: DataFrame, tag: str, training: bool = True) -> DataFrame:
        """Actions first, whose references are raw states, then states.  Without actions only where nothing is trained."""
        has = any(c.startswith("action.") for c in df.columns)
        if not has and training:
            raise ValueError("training needs actions")
        return self.apply_state(self.apply_action(df, tag) if has else df, tag)

    def unapply(self, df: DataFrame, tag: str, raw: bool = False) -> DataFrame:
        """States, unless ``raw`` says that state.* hold raw values, and with them the actions."""
        return self.unapply_action(df if raw else self.unapply_state(df, tag), tag)

    def joint_vectors(self, df: DataFrame, tag: str, max_state: int, max_action: int, max_horizon: int) -> DataFrame:
        """state, action and action_mask: model keys in order as one vector a row, padded with zeros, and where values are."""
        from .vectors import chunk_mask, padded, padded_chunk

        state = F.concat(*[F.col(f"`state.{k}`") for k in self.specs[tag]["state"].model_keys])
        keys = self.specs[tag]["action"].model_keys
        df = df.withColumn("state", padded(state, max_state))
        if f"action.{keys[0]}" not in df.columns:
            return df
        first = F.col(f"`action.{keys[0]}`")
        rows = F.transform(first, lambda row, t: F.concat(row, *[F.get(F.col(f"`action.{k}`"), t) for k in keys[1:]]))
        return df.withColumn("action", padded_chunk(rows, max_action, max_horizon)).withColumn("action_mask", chunk_mask(F.size(first), self.action_dim(tag), max_horizon, max_action))

    def decoded(self, df: DataFrame, tag: str, horizon: int, action: str = "action") -> DataFrame:
        """A model's padded actions back to absolute action.* columns, beside raw state.* ones."""
        from .vectors import split_chunk

        dims = {k: self.params(tag, "action", k)["dim"] for k in self.specs[tag]["action"].model_keys}
        return self.unapply_action(df.withColumns({f"action.{k}": x for k, x in split_chunk(F.col(action), dims, horizon).items()}), tag)


def _is_pose(action: ActionSpec) -> bool:
    return action.kind is Kind.EEF and action.layout is Layout.XYZ_ROT6D


def detect_clutch(state_keys: set[str]) -> bool:
    """Whether an embodiment's states declare engagement of both sides."""
    return set(ENGAGED.values()) <= state_keys
