"""Queries that bind the operators to tables."""

from parchment.plans import extraction_plans, fusion_plans, model_plans, raster_plans, registry_plans, relational_plans, streaming_plans, temporal_plans, text_plans

PLANS = (registry_plans, relational_plans, text_plans, fusion_plans, extraction_plans, streaming_plans, temporal_plans, model_plans, raster_plans)
