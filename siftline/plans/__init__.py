from siftline.plans.triage import (
    dashboard,
    export_result,
    make_review,
    review_and_export,
    run_pipeline,
)

__all__ = ["dashboard", "export_result", "make_review", "review_and_export", "run_pipeline"]
