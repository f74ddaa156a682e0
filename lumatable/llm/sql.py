"""Pieces of SQL shared by the oracles."""

_WRAP = r"[\s\x00\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\"''‘’“”«»`]+"

CAMERA = f"nullif(lower(regexp_replace(camera_model, '^{_WRAP}|{_WRAP}$', '', 'g')), '')"
