"""Multi-step plans: training, models, evaluation, driver queries."""
