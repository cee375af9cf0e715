"""Declared types of the corpus entities; nothing is inferred from data."""

from __future__ import annotations

TRACKS = ("EntityStructure", "ScientificLaw", "ScientificProcess")
#: Order of the dimensions in which relevance is scored.
DIMENSIONS = ("ScientificLaw", "EntityStructure", "ScientificProcess")
LEGACY_DIMENSIONS = ("ScientificConsistency", "EntityStructure", "ScientificProcess")

SEGMENT = "struct<filename string, width int, height int, labels array<string>, path string>"
REASONING = "map<string, struct<terms array<string>, visualization array<string>>>"
ARTICLE = (
    "image_id string, article_title string, article_abstract string, article_body string, figure_title string, "
    f"figure_caption string, subjects array<string>, local_path string, image_path string, segments array<{SEGMENT}>"
)
DETECTION = "image_id string, img_w int, img_h int, det_idx int, cls string, conf double, x1 double, y1 double, x2 double, y2 double"
RELEVANCE = "filename string, relevance map<string, struct<score double>>, confidence double"
CAPTION = (
    f"image_path string, reasoning {REASONING}, `sci-RCoT` string, rendered_text_stage2 array<string>, "
    "science_abstract_prompt string, retained_text_stage3 array<string>"
)
CHECKLIST = (
    "image_path string, used_prompt_mode string, core_tracks array<string>, "
    "generated_checklist struct<checklist array<struct<question string, category string>>, error string, raw string>"
)
EVALUATION = (
    "image_filename string, mode string, error string, evaluation "
    "struct<evaluation_results array<struct<category string, answer string, reason string>>, error string>"
)
SFT = "instruction string, input string, output string"
