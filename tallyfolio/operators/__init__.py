"""DataFrame operators: merging, jobs, model stages, results, rubric, evidence and reports."""
