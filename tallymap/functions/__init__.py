"""Column builders: geometry, projections, measures, text repair, boxes."""
