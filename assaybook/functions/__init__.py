"""Column -> Column rules, all built-in expressions."""

from .dates import date_only, report_date_parts, today_utc
from .forms import (
    doc_subtitle, form_defaults, form_map, is_doc_panel, is_form_panel, panel_kind,
    ultrasound_heading, ultrasound_labels,
)
from .numbers import clean_ids, is_numeric_id, js_number, list_limit, to_active, to_id, to_order
from .ranges import (
    cat_range, display_value, dog_range, is_cat, is_out_of_range, normalize_species, outside,
    parse_range, parse_result, reference_for,
)
from .text import (
    ci, clean_code, digits_only, escape_html, fill_text, first_text, image_url, is_phone_query,
    like_any, like_pattern, or_null, owner_key, pet_key, pet_label, rebook_key, safe_ext, trim,
)

__all__ = [name for name in dir() if not name.startswith("_")]
