"""Multi-step plans: choices that a model could make, evaluation, and augmentation end to end."""
