"""permeate.streaming"""
