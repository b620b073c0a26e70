from cadastrum.functions.display import display_boolean, display_date, display_number, display_text
from cadastrum.functions.numbers import (
    department_of,
    finite,
    french_number,
    full_commune_code,
    ratio,
    round_even,
)
from cadastrum.functions.text import (
    blank_to_null,
    fold_header,
    fold_snake,
    french_display_text,
    like_any,
    preview_label,
    preview_value,
    repair_text,
)

__all__ = [
    "blank_to_null",
    "department_of",
    "display_boolean",
    "display_date",
    "display_number",
    "display_text",
    "finite",
    "fold_header",
    "fold_snake",
    "french_display_text",
    "french_number",
    "full_commune_code",
    "like_any",
    "preview_label",
    "preview_value",
    "ratio",
    "repair_text",
    "round_even",
]
