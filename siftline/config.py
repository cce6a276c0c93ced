"""Column names, rule book and fixed texts."""

from __future__ import annotations

from dataclasses import dataclass

# Lead and score column names.
ID = "id"
NAME = "ten_khach"
PHONE = "sdt"
NEED = "nhu_cau_mo_ta"
SCORE = "score"
CLASS = "classification"
REASON = "reason"

LEAD_COLUMNS = (ID, NAME, PHONE, NEED)
SCORE_COLUMNS = (SCORE, CLASS, REASON)

# The three classes, in report order, and their display labels.
HOT = "HOT"
WARM = "WARM"
JUNK = "JUNK"
CLASSES = (HOT, WARM, JUNK)
CLASS_LABELS = {HOT: "HOT (VIP)", WARM: "WARM (Thường)", JUNK: "JUNK (Rác)"}

# Display headers.
DISTRIBUTION_HEADERS = {"label": "Phân loại", "n": "Số lượng"}
HISTOGRAM_HEADERS = {"score": "Điểm số", "n": "Số lượng khách"}
REVIEW_HEADERS = {
    ID: "Lead ID",
    NAME: "Tên Khách Hàng",
    PHONE: "Số Điện Thoại",
    NEED: "Mô Tả Nhu Cầu",
    SCORE: "Điểm Số",
    CLASS: "Phân Loại",
    REASON: "Lý Do Đánh Giá",
}

# Ordered phrases, reasons, sizes.
VIP_PHRASES = (
    "20 tỷ",
    "tài chính mạnh",
    "biệt thự",
    "penthouse",
    "shophouse",
    "quận 1",
    "ven sông",
    "chủ doanh nghiệp",
    "nhà đầu tư",
    "mua sỉ",
    "sổ hồng riêng",
)
JUNK_PHRASES = (
    "nhầm số",
    "không có nhu cầu",
    "dữ liệu cũ",
    "hỏi giá cho vui",
    "chưa có ý định",
    "bảo hiểm",
    "vay vốn",
    "thuê bao",
    "không bắt máy",
)
VIP_REASON = "VIP: Chứa từ khóa '{}'"
JUNK_REASON = "Rác: Chứa từ khóa '{}'"
NEUTRAL_REASON = "Lead bình thường (nhu cầu hợp lý)"
REASON_SEPARATOR = "; "
BATCH_SIZE = 20

# Name of the column that says how often a joined row occurs (see operators/enrich.py).
COPIES = "_copies"

# Columns the engine adds on the way. A lead table may not have them.
RESERVED = (
    COPIES,
    "_block",
    "_copy",
    "_file",
    "_file_row",
    "_in_part",
    "_junk",
    "_part",
    "_scored_id",
    "_step",
    "_text",
    "_theirs",
    "_tie",
    "_vip",
    "ordinal",
    "review_part",
    "row_id",
)


@dataclass(frozen=True)
class RuleBook:
    """Ordered phrase lists with the scores and texts they lead to."""

    vip_phrases: tuple[str, ...] = VIP_PHRASES
    junk_phrases: tuple[str, ...] = JUNK_PHRASES
    default_score: int = 10
    vip_score: int = 50
    junk_score: int = -50
    hot_from: int = 50
    junk_below: int = 0
    vip_reason: str = VIP_REASON
    junk_reason: str = JUNK_REASON
    neutral_reason: str = NEUTRAL_REASON
    separator: str = REASON_SEPARATOR


DEFAULT_RULES = RuleBook()


@dataclass(frozen=True)
class Rubric:
    """Text put before and after the JSON list of leads in a model request."""

    head: str
    tail: str


DEFAULT_RUBRIC = Rubric(
    head=(
        "You rate property-buyer leads by what they say they need.\n"
        "\n"
        "50 points, class HOT, when any of these holds:\n"
        "- a budget of 20 billion VND or more, or plainly strong finances;\n"
        "- premium property: detached villa, penthouse, street-front shophouse, "
        "industrial land, large office floors;\n"
        "- a prime place: District 1, riverside, a flagship township;\n"
        "- a business owner, professional investor or bulk buyer;\n"
        "- clean legal papers wanted, or a wish to meet the developer in person.\n"
        "-50 points, class JUNK, when any of these holds:\n"
        "- a price far below the market for what is wanted;\n"
        "- no need, wrong number, outdated record;\n"
        "- not in good faith, or asking prices for fun;\n"
        "- an advert for insurance, loans or other services;\n"
        "- cannot be reached.\n"
        "10 points, class WARM, in every other case, such as mid-range homes of "
        "3 to 10 billion VND, buyers who need a bank loan, or a real need with open "
        "questions on papers or place.\n"
        "\n"
        "The leads, as JSON:\n"
    ),
    tail=(
        "\n"
        "\n"
        "Answer with one JSON list and nothing else. One object per lead, with the keys "
        '"id" (as given), "score" (a number), "classification" ("HOT", "WARM" or "JUNK") '
        'and "reason" (one short sentence in Vietnamese).\n'
    ),
)
