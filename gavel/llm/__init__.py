"""Large-scale training-data operators."""
