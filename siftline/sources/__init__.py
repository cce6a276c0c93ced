from siftline.sources.handover import export_handover, read_handover
from siftline.sources.leads import EmptyLeads, read_leads, require_rows, row_count
from siftline.sources.session import build_session
from siftline.sources.store import materialize, shared_dir

__all__ = [
    "EmptyLeads",
    "build_session",
    "export_handover",
    "materialize",
    "read_handover",
    "read_leads",
    "require_rows",
    "row_count",
    "shared_dir",
]
