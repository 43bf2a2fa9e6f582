"""Streaming: intentionally empty.

The modelled application is a daily batch fired by a timer; it has no
streams, watermarks or state. Usage and history are append-only tables that
the batch plans read directly.
"""
