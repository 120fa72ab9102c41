"""Readers of feeds, seeds and queues, and the lookup tables that stand for the network, the model and the geocoder."""
