"""Score and policy columns: actions, tiers, model outputs, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.functions.text import _col
from modwarden.profiles import NsfwPolicy, ScorePolicy, ViolencePolicy

ACTIONS = ("clean", "flag", "block")


def action_rank(action: Column | str) -> Column:
    """clean < flag < block, so a maximum is the OR rule."""
    a = _col(action)
    return F.when(a == "block", 2).when(a == "flag", 1).otherwise(0)


def rank_action(rank: Column) -> Column:
    return F.when(rank == 2, "block").when(rank == 1, "flag").otherwise("clean")


def clamp01(c: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(c)))


def _clamped_or_zero(c: Column | str) -> Column:
    c = _col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(clamp01(c))


def sigmoid(x: Column | str) -> Column:
    """Stable on both sides; 0 for a value that is no finite number."""
    x = _col(x).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    small = F.exp(-F.abs(x))
    return F.when(~finite, 0.0).when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def softmax_positive(negative: Column | str, positive: Column | str) -> Column:
    """Probability of the second class of a two-class head."""
    return sigmoid(_col(positive) - _col(negative))


def logits_to_scores(logits: Column | str, labels: tuple[str, ...]) -> Column:
    """``map<label,score>``; a missing logit scores 0."""
    logits = _col(logits)
    return F.create_map(
        *[x for i, name in enumerate(labels) for x in (F.lit(name), sigmoid(F.try_element_at(logits, F.lit(i + 1))))]
    )


def canonical_labels(predictions: Column | str) -> Column:
    """``array<struct<label,score>>`` to a score per known class: largest wins, missing is 0."""
    predictions = _col(predictions)

    def named(p: Column) -> Column:
        label = F.lower(F.trim(p["label"]))
        return F.when(label == "drawing", "drawings").otherwise(label)

    def best(name: str) -> Column:
        return F.aggregate(
            F.coalesce(predictions, F.array().cast("array<struct<label:string,score:double>>")),
            F.lit(0.0),
            lambda acc, p: F.when(
                (named(p) == name) & p["score"].isNotNull() & ~F.isnan(p["score"])
                & (F.abs(p["score"]) != float("inf")),
                F.greatest(acc, clamp01(p["score"])),
            ).otherwise(acc),
        )

    return F.create_map(*[x for name in fv.NSFW_CLASSES for x in (F.lit(name), best(name))])


def text_action(score: Column | str, policy: ScorePolicy = ScorePolicy()) -> Column:
    s = _col(score)
    return F.when(s >= policy.block, "block").when(s >= policy.flag, "flag").otherwise("clean")


def text_tier(score: Column | str, policy: ScorePolicy = ScorePolicy()) -> Column:
    s = _col(score)
    return F.when(s >= policy.block, "hate").when(s >= policy.flag, "mild").otherwise("none")


def nsfw_action(scores: Column | str, policy: NsfwPolicy = NsfwPolicy()) -> Column:
    scores = _col(scores)

    def of(name: str) -> Column:
        return F.coalesce(F.try_element_at(scores, F.lit(name)), F.lit(0.0))

    worst = F.greatest(F.lit(0.0), *[of(c) for c in policy.block_classes])
    return (
        F.when(worst >= policy.block, "block")
        .when((worst >= policy.flag) | (of("sexy") >= policy.sexy_flag), "flag")
        .otherwise("clean")
    )


def gore_score(violence: Column | str, sensitive: Column | str) -> Column:
    return F.sqrt(_clamped_or_zero(violence) * _clamped_or_zero(sensitive))


def violence_action(
    violence: Column | str, sensitive: Column | str, weapon: Column | str, policy: ViolencePolicy = ViolencePolicy()
) -> Column:
    v, w = _clamped_or_zero(violence), _clamped_or_zero(weapon)
    gore = gore_score(violence, sensitive)
    return (
        F.when((v >= policy.block) | (gore >= policy.gore_block), "block")
        .when((v >= policy.flag) | (gore >= policy.gore_flag) | (w >= policy.weapon_flag), "flag")
        .otherwise("clean")
    )


def strongest_image(
    nsfw: Column | str, violence: Column | str, nsfw_reason: Column | None = None, violence_reason: Column | None = None
) -> Column:
    """Stronger of two detectors, the first on a tie; a clean result of a failed detector says so."""
    nsfw, violence = _col(nsfw), _col(violence)
    second = action_rank(violence) > action_rank(nsfw)
    action = F.when(second, violence).otherwise(nsfw)
    reasons = F.concat_ws(" ", *[r for r in (nsfw_reason, violence_reason) if r is not None]) if (
        nsfw_reason is not None or violence_reason is not None
    ) else F.lit("")
    failed = (action == "clean") & reasons.rlike(fv.DETECTOR_FAILURE_PATTERN)
    return F.struct(
        action.alias("action"),
        F.lit("image").alias("source"),
        F.when(second, "violence-gore").otherwise("nsfw").alias("detector"),
        F.when(failed, "classify-failed").alias("reason"),
    )


def is_cacheable(action: Column | str, *reasons: Column) -> Column:
    """A verdict worth keeping: a known action and no trace of a failed detector."""
    text = F.concat_ws(" ", *reasons) if reasons else F.lit("")
    return F.coalesce(_col(action).isin(*ACTIONS), F.lit(False)) & ~text.rlike(fv.FAILURE_PATTERN)


def toxic_label_score(scores: Column | str) -> Column:
    """Largest score of a label that names toxicity without a negation."""
    names = "|".join(fv.TOXIC_LABEL_WORDS)
    negated = "^(" + "|".join(fv.NEGATED_LABEL_PREFIXES) + ")"
    kept = F.map_filter(
        _col(scores), lambda k, v: F.lower(k).rlike(names) & ~F.lower(k).rlike(negated)
    )
    return F.array_max(F.map_values(kept))


def label_group_score(scores: Column | str, labels: tuple[str, ...]) -> Column:
    scores = _col(scores)
    return F.greatest(F.lit(0.0), *[F.coalesce(F.try_element_at(scores, F.lit(n)), F.lit(0.0)) for n in labels])


def grouped_label_binarize(scores: Column | str, hate_block: float = 0.70, mild_flag: float = 0.55) -> Column:
    """1 when the hate group or the mild group passes its own cut-off."""
    hate, mild = label_group_score(scores, fv.HATE_LABELS), label_group_score(scores, fv.MILD_LABELS)
    return F.when((hate >= hate_block) | (mild >= mild_flag), 1).otherwise(0)


def normalize_setting(value: Column | str, default: bool = True) -> Column:
    """A boolean as written, else the default."""
    v = F.lower(_col(value).cast("string"))
    return F.when(v == "true", True).when(v == "false", False).otherwise(F.lit(default))


def settings_policy(image: Column | str, ocr: Column | str, lexicon: Column | str) -> Column:
    return F.concat_ws(":", *[_col(c).cast("int").cast("string") for c in (image, ocr, lexicon)])


def proxy_score(text: Column | str) -> Column:
    """Deterministic stand-in for a model score, equal in every engine: 28 bits of the md5."""
    return F.conv(F.substring(F.md5(_col(text)), 1, 7), 16, 10).cast("long") / F.lit(268435455.0)
