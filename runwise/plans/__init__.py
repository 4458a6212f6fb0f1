from runwise.plans.analyzer import analyze_runs
from runwise.plans.records import own_record
from runwise.plans.workload import run_workload

__all__ = ["analyze_runs", "own_record", "run_workload"]
