from fleetlog.plans.analysis import analyse, candidate_lines
from fleetlog.plans.ask import answer

__all__ = ["analyse", "candidate_lines", "answer"]
