"""The vocabulary of statements: anchors of rows, headers of forms and year columns, all data."""

from __future__ import annotations

from dataclasses import dataclass

# Patterns of the rows' labels. Java needs the flags i, u and U for what other engines do by default.
ROW_PATTERNS = {
    "bu_revenue": r"(?:пословни|poslovni)[\s\-]*(?:приходи|prihodi)",
    "bs_assets": r"(?:укупна|ukupna)[\s\-]*(?:актива|aktiva)",
    "bs_loss": r"(?:губитак|gubitak)[\s\-]+(?:изнад|iznad)[\s\-]+(?:висине|visine)[\s\-]+(?:капитала|kapitala|капитал|kapital)",
    "bu_revenue_aop": r"\b0*1001\b",
    "bs_assets_aop": r"\b0*0059\b",
    "bs_loss_aop": r"\b0*0401\b",
    "bs_capital_aop0401": r"(?:\bA\s*\.\s*капитал\b.*?0*401|\bAOP\s*0*401\b|\bАОП\s*0*401\b)",
}

# Spellings of the rows' labels and codes.
ROW_SYNONYMS = {
    "bu_revenue": ["пословни приходи", "poslovni prihodi", "приходи из пословања", "пословни-приходи", "poslovni-prihodi"],
    "bs_assets": ["укупна актива", "ukupna aktiva", "укупна актива (у 000 рсд)", "ukupna-aktiva"],
    "bs_loss": [
        "губитак изнад висине капитала",
        "gubitak iznad visine kapitala",
        "губитак изнад висине капитала (у 000 рсд)",
        "gubitak-iznad-visine-kapitala",
        "губитак изнад висине капитал",
        "gubitak iznad visine kapital",
    ],
    "bu_revenue_aop": ["1001", "01001", "aop 1001", "аоп 1001"],
    "bs_assets_aop": ["0059", "059", "aop 0059", "аоп 0059"],
    "bs_loss_aop": ["0401", "401", "aop 0401", "аоп 0401"],
    "bs_capital_aop0401": [
        "a. капитал",
        "а. капитал",
        "a капитал",
        "a. kapital",
        "a kapital",
        "а капитал",
        "капитал (аоп 0401)",
        "капитал аоп 0401",
        "капитал aop 0401",
        "capital aop 0401",
        "kapital aop 0401",
        "aop 0401",
        "аоп 0401",
        "aop0401",
        "a. capital",
    ],
}

# Headers of forms, of year columns, and of the roster's id column.
FORM_PATTERNS = {"bu": r"билан[сc]\s+успеха|bilans\s+uspeha", "bs": r"билан[сc]\s+стања|bilans\s+stanja"}
YEAR_PATTERNS = {"current": r"текућ[ае]\s+годин[ае]", "previous": r"претходн[ае]\s+годин[ае]"}
YEAR_SYNONYMS = {
    "current": ["текућа година", "текуће године", "текућа г.", "tekuca godina", "tekuce godine"],
    "previous": ["претходна година", "претходне године", "претходна г.", "prethodna godina", "prethodne godine"],
}
ID_HEADERS = ["матични број", "матични бр", "мат. број", "mat. broj", "maticni broj", "matični broj", "maticni br", "matični br", "mb"]
CODE_COLUMN_TOKENS = ["aop", "аоп", "аор"]


def java(pattern: str) -> str:
    return "(?iuU)" + pattern


@dataclass(frozen=True)
class Field:
    """A value to extract: its form, the anchor of its row, bounds, and the name it is reported under."""

    key: str
    form: str
    anchor: str
    min_value: int | None = None
    max_value: int | None = None


#: Fields read from a row. `capital` feeds the derived field capital_loss, and `loss_row` is its fallback.
FIELDS = {
    "revenue": Field("revenue", "bu", "bu_revenue"),
    "assets": Field("assets", "bs", "bs_assets", min_value=0),
    "capital": Field("capital", "bs", "bs_capital_aop0401"),
    "loss_row": Field("loss_row", "bs", "bs_loss"),
}
