"""What a prompt asks of an image, and how far the image keeps to it."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np

from . import image_measures as M

# Wordings of the requests.
BACKGROUNDS = (
    r"(?:plain|seamless)?\s*(white|black|gray|grey|blue|red|green|light[\s-]?gray|light[\s-]?grey|deep blue)\s*background",
    r"background\s*(?:must\s+)?(?:be(?:come)?|:)\s*(?:a\s+)?([\w\s-]+?)(?:\s*[,;.]|\s+with)",
)
COLOURS = ("matte-black", "matte black", "stainless-steel", "silver", "blue", "red", "white", "yellow", "green", "pink", "black", "cyan", "gold", "orange", "purple", "brown", "gray", "grey", "pastel", "deep blue", "light cyan")
OBJECTS = (r"must include[:\s]+(.+?)(?:\.|$)", r"include\s+(?:exactly\s+)?(?:these\s+)?objects?\s*[:\s]+(.+?)(?:\.|$)", r"place\s+(?:exactly\s+)?(\d+\s+\w+)")
OBJECT_WORDS = ("laptop", "notebook", "pen", "coffee mug", "plant", "smartphone", "phone", "sticky note", "paperclip", "bottle", "water bottle", "arrow", "callout")
FORBIDDEN = (r"no\s+([\w\s,]+?)(?:\.|$)", r"do\s+not\s+add\s+([\w\s,]+?)(?:\.|$)", r"without\s+([\w\s,]+?)(?:\.|$)")
STYLES = (
    "photorealistic", "realistic", "oil painting", "watercolor", "minimalist", "cyberpunk", "blueprint", "clay animation", "stop-motion", "flat lay", "product photo", "studio", "overhead", "top-down", "technical", "line art",
    "cartoon", "illustration", "sketch", "vintage", "retro", "3d render",
)
COUNTS = (r"exactly\s+(\d+)\s+([\w\s]+?)(?:\s*[,;.]|\s+visible|\s+on)", r"(\d+)\s+(callout\s+arrows?|sticky\s+notes?|paperclips?|objects?)")
TARGETS = {
    "white": (255, 255, 255), "black": (0, 0, 0), "light gray": (200, 200, 200), "light-gray": (200, 200, 200), "light grey": (200, 200, 200), "gray": (128, 128, 128), "grey": (128, 128, 128), "blue": (0, 0, 200),
    "deep blue": (0, 0, 139), "red": (200, 0, 0), "green": (0, 128, 0),
}
PHOTO, DRAWN, PAINTED, ABOVE = ("photorealistic", "realistic", "product photo", "studio"), ("blueprint", "technical", "line art"), ("watercolor", "oil painting"), ("flat lay", "overhead", "top-down")


@dataclass(frozen=True)
class Asked:
    backgrounds: tuple[str, ...]
    colours: tuple[str, ...]
    objects: tuple[str, ...]
    forbidden: tuple[str, ...]
    styles: tuple[str, ...]
    composition: str | None
    texts: tuple[str, ...]
    counts: tuple[tuple[str, int], ...]
    lighting: str | None


def _pieces(patterns, text: str, longer_than: int = 0) -> list[str]:
    return [x for p in patterns for m in re.findall(p, text) for x in map(str.strip, re.split(r"[,;]", m)) if len(x) > longer_than]


@functools.lru_cache(maxsize=1024)
def parse(prompt: str) -> Asked:
    low = prompt.lower()
    objects = _pieces(OBJECTS, low)
    for word in OBJECT_WORDS:
        if word in low and word not in objects:
            objects.append(word)
    composition = "centered" if "center" in low else "overhead" if any(k in low for k in ABOVE) else "3/4 angle" if "3/4 angle" in low else None
    lighting = "studio" if "softbox" in low or "studio light" in low else "natural" if "daylight" in low or "natural" in low else "soft" if "soft" in low and "light" in low else None
    texts = re.findall(r'write\s+(?:exactly\s+)?(?:this\s+)?text[:\s]+"?([^"]+?)"?\s*$', low, re.MULTILINE)
    texts += re.findall(r"text\s+in\s+uppercase:\s+(.+?)(?:\s*$|\s*\n)", prompt, re.MULTILINE)
    texts += re.findall(r"containing\s+only\s+(?:a\s+)?(?:single\s+)?letter:\s*([A-Z](?:,\s*[A-Z])*)", low, re.MULTILINE)
    return Asked(
        backgrounds=tuple(m.strip() for p in BACKGROUNDS for m in re.findall(p, low)),
        colours=tuple(c for c in COLOURS if c in low),
        objects=tuple(objects),
        forbidden=tuple(_pieces(FORBIDDEN, low, 2)),
        styles=tuple(s for s in STYLES if s in low),
        composition=composition,
        texts=tuple(texts),
        counts=tuple((thing.strip(), int(n)) for p in COUNTS for n, thing in re.findall(p, low)),
        lighting=lighting,
    )


def _background(x: np.ndarray, wanted: str) -> float:
    """By the distance of the mean colour of the four borders."""
    b = max(5, min(x.shape[:2]) // 20)
    border = np.concatenate([p.reshape(-1, 3) for p in (x[:b], x[-b:], x[:, :b], x[:, -b:])]).mean(axis=0)
    return max(0.0, 100 - 0.5 * float(np.linalg.norm(border - np.array(TARGETS.get(wanted, (128, 128, 128))))))


def _colours(x: np.ndarray, wanted: tuple[str, ...]) -> float:
    held = [c["name"] for c in M.palette(x, 8)["palette"]]
    plain = [w.replace("-", " ").replace("matte ", "").replace("stainless steel", "silver") for w in wanted]
    return float(np.mean([100.0 * any(w in h or h in w for h in held) for w in plain]))


def _style(style: str, found: dict) -> float:
    sharp, detail, light = found["sharpness"]["sharpness_score"], found["edge_density"]["detail_score"], found["brightness_contrast_saturation"]
    if style in PHOTO:
        score = sharp * 0.4 + detail * 0.3 + light["contrast_score"] * 0.3
    elif style in DRAWN:
        score = detail * 0.5 + (100 - found["color_histogram"]["color_diversity_score"]) * 0.5
    elif style in PAINTED:
        score = light["saturation_score"] * 0.5 + (100 - sharp) * 0.3 + 20
    elif style in ABOVE:
        score = found["composition"]["quadrant_balance"] * 80 + 20
    else:
        score = 50.0
    return round(min(100.0, score), 1)


def check(x: np.ndarray, asked: Asked, found: dict) -> dict[str, float | None]:
    """Scores of 0 to 100 for what the prompt asks (None where it doesn't), and their mean, or 50; found: the image's measures."""
    light, frame = found["brightness_contrast_saturation"], found["composition"]
    out: dict[str, float | None] = dict.fromkeys(("background_color", "color_presence", "style_adherence", "composition_adherence", "lighting_adherence"))
    if asked.backgrounds:
        out["background_color"] = _background(x, asked.backgrounds[0])
    if asked.colours:
        out["color_presence"] = _colours(x, asked.colours)
    if asked.styles:
        out["style_adherence"] = round(float(np.mean([_style(s, found) for s in asked.styles])), 1)
    if asked.composition:
        by = {"centered": max(0.0, 100 - 300 * frame["center_deviation"]), "overhead": frame["quadrant_balance"] * 100}
        out["composition_adherence"] = by.get(asked.composition, frame["composition_score"])
    if asked.lighting:
        by = {"studio": min(100.0, light["contrast_score"] * 0.6 + light["brightness_score"] * 0.4), "natural": light["brightness_score"]}
        out["lighting_adherence"] = by.get(asked.lighting, max(0.0, 100 - light["rms_contrast"] * 0.5))
    scores = [s for s in out.values() if s is not None]
    out = {k: None if v is None else round(float(v), 1) for k, v in out.items()}
    return out | {"overall_constraint_score": round(float(np.mean(scores)), 1) if scores else 50.0}
